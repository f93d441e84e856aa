"""Writers, and a cache that a change of columns invalidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` for one small file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def json_lines(df: DataFrame, path: str, order: Sequence[str] = (), append: bool = False) -> None:
    """JSON lines in the given order (without the order columns' help a reader can't tell it)."""
    (df.orderBy(*order) if order else df).write.mode("append" if append else "overwrite").json(path)


def signal_archive(signals: DataFrame, path: str | None = None) -> DataFrame:
    """(key, v): record and lead as one key, values as float (Spark has no half precision)."""
    out = signals.select(F.concat_ws("_", "record", "lead").alias("key"), F.col("v").cast("array<float>").alias("v"))
    if path:
        parquet(out, path)
    return out


def cached(spark, path: str, columns: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it has exactly these columns, else ``make()`` written there."""
    try:
        found = spark.read.parquet(path)
        if found.columns == list(columns):
            return found
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    parquet(make(), path)
    return spark.read.parquet(path)
