"""Helpers of the query modules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def r6(df: DataFrame) -> DataFrame:
    """All floating columns as double with six decimals; the shift breaks ties alike in both engines."""
    return df.select(*((F.round(F.col(f"`{n}`").cast("double") + F.lit(1e-10), 6) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes))


def d6(sql: str, *columns: str) -> str:
    """The same for DuckDB."""
    inner = sql.strip()
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + 1e-10::DOUBLE, 6) + 0.0 AS {c}' for c in columns)}) FROM ({inner})"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
