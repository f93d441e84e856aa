"""Bucket and month tables of telemetry.

A bucket's state is algebraic (counts, sums, sums of squares, extremes), so states of parts of
the data merge into the state of all: one aggregate with map-side combination, or
``merge_partials`` over states kept from earlier runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar, cyclic, floor_time, year_month
from ..functions.nulls import flag, ratio, zsum

#: Sensors, differences of bucket means, raw differences, thresholds, dayparts.
SENSORS = [f"t{i}" for i in range(1, 14)] + ["x1"]
MEAN_DELTAS = [("t2", "t1"), ("t5", "t3"), ("t6", "t4"), ("t7", "t2"), ("t9", "t1")]
RAW_DELTAS = [("delta_t2_t1", "t2", "t1"), ("delta_t5_t3", "t5", "t3"), ("delta_t6_t4", "t6", "t4"), ("delta_t8_t1", "t8", "t1"), ("lift_t5_t1", "t5", "t1"), ("lift_t8_t1", "t8", "t1")]
COLD, WARM = 0.35, 0.55
DAYPARTS = ("night", "morning", "afternoon", "evening")
MASKED_SUMS = ("t1", "t5", "t8", "x1")


def present(df: DataFrame, columns: Sequence[str] = SENSORS) -> list[str]:
    return [c for c in columns if c in df.columns]


def with_flags(df: DataFrame) -> DataFrame:
    """active, x2_filled, x2_count, cold, warm, weekend and daypart of each row."""
    return df.select(
        "*",
        flag(F.col("x1") > 0).alias("active"),
        F.coalesce("x2", F.lit(0.0)).alias("x2_filled"),
        flag(F.col("x2").isNotNull()).alias("x2_count"),
        flag(F.col("t1") < COLD).alias("cold"),
        flag(F.col("t1") >= WARM).alias("warm"),
        flag(F.weekday("timedate") >= 5).alias("weekend"),
        F.floor(F.hour("timedate") / 6).cast("int").alias("daypart"),
    )


def raw_deltas(df: DataFrame) -> list[Column]:
    """The differences of raw sensors for which ``df`` has both columns."""
    return [(F.col(a) - F.col(b)).alias(n) for n, a, b in RAW_DELTAS if a in df.columns and b in df.columns]


def _state(columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        out += [zsum(x).alias(f"{c}_sum"), zsum(x * x).alias(f"{c}_sq"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return out


def bucket_partials(df: DataFrame, freq: str = "D", columns: Sequence[str] | None = None) -> DataFrame:
    """The state of every (deviceId, bucket): rows without a device or a valid time are left out."""
    columns = columns or present(df)
    x2 = F.col("x2").cast("double")
    return (
        df.where(F.col("timedate").isNotNull() & F.col("deviceId").isNotNull())
        .groupBy("deviceId", floor_time(F.col("timedate"), freq).alias("date"))
        .agg(
            F.min(F.when(F.col("period").isNotNull(), F.struct("timedate", "period"))).alias("first_period"),
            F.max("deviceType").alias("deviceType"),
            F.max("x3").alias("x3"),
            F.count("*").alias("n_rows"),
            F.sum(flag(F.col("x1") > 0)).alias("active_sum"),
            zsum(x2).alias("x2_sum"),
            F.count(x2).alias("x2_count"),
            *_state(columns),
        )
    )


def merge_partials(states: DataFrame) -> DataFrame:
    """States of the same buckets from several parts as one."""
    rules = {"min": F.min, "max": F.max}
    keys = ("deviceId", "date")
    merged = []
    for c in states.columns:
        if c in keys:
            continue
        how = F.min if c == "first_period" else F.max if c in ("deviceType", "x3") else rules.get(c.rpartition("_")[2], F.sum)
        merged.append(how(c).alias(c))
    return states.groupBy(*keys).agg(*merged)


def moments(c: str, n: Column) -> list[Column]:
    """Mean and deviation over all rows of a bucket, missing ones counted as 0, and extremes."""
    mean = F.col(f"{c}_sum") / n
    return [
        mean.alias(f"{c}_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}_sq") / n - mean * mean)).alias(f"{c}_std"),
        F.col(f"{c}_min"),
        F.col(f"{c}_max"),
    ]


def finish_buckets(states: DataFrame) -> DataFrame:
    """The feature table of bucket states."""
    columns = [c.removesuffix("_sum") for c in states.columns if c.endswith("_sq")]
    columns = [c.removesuffix("_sq") for c in columns]
    n, parts = F.col("n_rows"), calendar(F.col("date"))
    doy = cyclic(parts["dayofyear"], 366)
    tod = cyclic(parts["hour"] * 60 + parts["minute"], 1440)
    deltas = [(F.col(f"{a}_sum") / n - F.col(f"{b}_sum") / n).alias(f"delta_{a}_{b}") for a, b in MEAN_DELTAS if a in columns and b in columns]
    return states.select(
        "deviceId",
        "date",
        F.col("first_period.period").alias("period"),
        *(v.alias(k) for k, v in parts.items()),
        doy[0].alias("doy_sin"),
        doy[1].alias("doy_cos"),
        tod[0].alias("tod_sin"),
        tod[1].alias("tod_cos"),
        "deviceType",
        "x3",
        "n_rows",
        (F.col("active_sum") / n).alias("active_ratio"),
        *(m for c in columns for m in moments(c, n)),
        *deltas,
        ratio(F.col("x2_sum"), F.col("x2_count")).alias("target_x2"),
    )


def time_features(df: DataFrame, freq: str = "D", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per device and bucket; one exchange."""
    return finish_buckets(bucket_partials(df, freq, columns))


def month_partials(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The state of every (deviceId, year, month), with masked sums by daypart, cold, warm and weekend."""
    columns = columns or present(df)
    rows = with_flags(df.where(F.col("timedate").isNotNull() & F.col("deviceId").isNotNull()))
    rows = rows.select("*", *raw_deltas(df))
    columns = [*columns, *(n for n, a, b in RAW_DELTAS if a in df.columns and b in df.columns)]
    masks = {d: F.col("daypart") == i for i, d in enumerate(DAYPARTS)} | {k: F.col(k) == 1 for k in ("cold", "warm", "weekend")}
    masked = []
    for k, m in masks.items():
        masked.append(F.sum(flag(m)).alias(f"{k}_rows"))
        masked += [zsum(F.when(m, F.col(c).cast("double"))).alias(f"{k}_{c}_sum") for c in MASKED_SUMS if c in df.columns]
    return rows.groupBy("deviceId", F.year("timedate").alias("year"), F.month("timedate").alias("month")).agg(
        F.max("deviceType").alias("deviceType"),
        F.max("x3").alias("x3"),
        F.count("*").alias("n_rows"),
        F.sum("active").alias("active_sum"),
        zsum(F.col("x2").cast("double")).alias("x2_sum"),
        F.count("x2").alias("x2_count"),
        *_state(columns),
        *masked,
    )


def merge_months(states: DataFrame) -> DataFrame:
    keys = ("deviceId", "year", "month")
    rules = {"min": F.min, "max": F.max}
    merged = [(F.max if c in ("deviceType", "x3") else rules.get(c.rpartition("_")[2], F.sum))(c).alias(c) for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(*merged)


def finish_months(states: DataFrame) -> DataFrame:
    """The month table: moments, shares, masked means, cyclic month, target (no lags: see ``enrich``)."""
    columns = [c.removesuffix("_sq") for c in states.columns if c.endswith("_sq")]
    n = F.col("n_rows")
    masks = [*DAYPARTS, "cold", "warm", "weekend"]
    sin, cos = cyclic(F.col("month"), 12)
    means = [ratio(F.col(f"{k}_{c}_sum"), F.col(f"{k}_rows")).alias(f"{k}_{c}_mean") for k in masks for c in MASKED_SUMS if f"{k}_{c}_sum" in states.columns]
    return states.select(
        "deviceId",
        "year",
        "month",
        year_month(F.col("year"), F.col("month")).alias("ym"),
        sin.alias("month_sin"),
        cos.alias("month_cos"),
        "deviceType",
        "x3",
        "n_rows",
        (F.col("active_sum") / n).alias("active_ratio"),
        *((F.col(f"{k}_rows") / n).alias(f"{k}_share") for k in masks),
        *(m for c in columns for m in moments(c, n)),
        *means,
        ratio(F.col("x2_sum"), F.col("x2_count")).alias("target_x2"),
    )


def monthly_features(df: DataFrame) -> DataFrame:
    return finish_months(month_partials(df))


def period_summary(features: DataFrame) -> DataFrame:
    """Devices and rows by period and month, missing keys included."""
    return features.groupBy("period", "year", "month").agg(F.countDistinct("deviceId").alias("devices"), F.count("*").alias("rows"))
