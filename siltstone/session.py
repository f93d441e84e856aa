"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "siltstone", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive plans; ``conf`` adds settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
