"""Declared schemas, and the schema that column names imply."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType, TimestampNTZType

# Types by column name; all others are float.
_TEXT = ("deviceId", "period")
_SHORT = ("x3", "deviceType")
_INT = ("year", "month", "dayofyear", "weekday", "hour", "minute", "is_weekend", "n_rows", "ym")
_TIME = ("date",)


def of_columns(names: Iterable[str]) -> StructType:
    """Schema of a feature file from its header."""

    def kind(n: str):
        return StringType() if n in _TEXT else ShortType() if n in _SHORT else IntegerType() if n in _INT else TimestampNTZType() if n in _TIME else FloatType()

    return StructType([StructField(n, kind(n)) for n in names])


def telemetry(sensors: Sequence[str] = tuple(f"t{i}" for i in range(1, 14))) -> StructType:
    text = [StructField(n, StringType()) for n in ("deviceId", "timedate", "period")]
    short = [StructField(n, ShortType()) for n in ("x3", "deviceType")]
    return StructType([*text, *short, *(StructField(n, FloatType()) for n in (*sensors, "x1", "x2"))])


DEVICES = StructType([StructField("deviceId", StringType()), StructField("latitude", DoubleType()), StructField("longitude", DoubleType())])
DATAPOINTS = StructType([StructField(n, StringType()) for n in ("id", "repo", "revision", "path")] + [StructField("modified", ArrayType(StringType()))] + [StructField(n, StringType()) for n in ("prefix", "suffix", "archive")])
PREDICTIONS = StructType([StructField(n, StringType()) for n in ("context", "prefix", "suffix")])
