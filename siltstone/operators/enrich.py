"""Geo join, lags, rolling and expanding windows. All windows of a function share one specification, so one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clip

#: Row offsets and widths.
LAGS, ROLLS = (1, 2, 3, 7, 14), (3, 7, 14)
RAW_LAGS = (1, 12, 288)
MONTH_LAGS = (1, 2)


def with_geo(df: DataFrame, devices: DataFrame | None) -> DataFrame:
    """Left join of (deviceId, latitude, longitude) and what follows from them; unchanged without a device table.

    Spark broadcasts the device table where its measured size allows it.
    """
    if devices is None:
        return df
    lat, lon = F.col("latitude"), F.col("longitude")
    geo = devices.select("deviceId", "latitude", "longitude", F.sqrt(lat * lat + lon * lon).alias("geo_r"), (lat + lon).alias("geo_sum"), (lat - lon).alias("geo_diff"))
    return df.join(geo, "deviceId", "left")


def device_window(order: str = "date") -> Window:
    return Window.partitionBy("deviceId").orderBy(order)


def lagged(columns: Sequence[str], lags: Sequence[int] = LAGS, order: str = "date") -> list[Column]:
    """Values of earlier rows (not earlier days: gaps aren't filled)."""
    w = device_window(order)
    return [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in lags]


def rolling(columns: Sequence[str], widths: Sequence[int] = ROLLS, order: str = "date") -> list[Column]:
    """Means of the k rows before, as far as there are any."""
    w = device_window(order)
    return [F.avg(c).over(w.rowsBetween(-k, -1)).alias(f"{c}_roll{k}") for c in columns for k in widths]


def momentum(columns: Sequence[str], lags: Sequence[int] = (1, 7), order: str = "date") -> list[Column]:
    w = device_window(order)
    return [(F.col(c) - F.lag(c, k).over(w)).alias(f"{c}_mom{k}") for c in columns for k in lags]


def expanding(columns: Sequence[str], order: str = "date") -> list[Column]:
    """Mean of all earlier rows, the value centred by it, and its product with the month."""
    past = device_window(order).rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for c in columns:
        mean = F.avg(c).over(past)
        out += [mean.alias(f"{c}_hist"), (F.col(c) - mean).alias(f"{c}_dev_center"), (F.col(c) * F.col("month")).alias(f"{c}_month_inter")]
    return out


def enriched(features: DataFrame, devices: DataFrame | None, columns: Sequence[str], centred: Sequence[str]) -> DataFrame:
    """The feature table with geo columns and all windows."""
    return with_geo(features, devices).select("*", *lagged(columns), *rolling(columns), *momentum(columns), *expanding(centred))


def month_lags(months: DataFrame, columns: Sequence[str]) -> DataFrame:
    w = device_window("ym")
    lags = [F.lag(c, k).over(w).alias(f"{c}_lag{k}m") for c in columns for k in MONTH_LAGS]
    return months.select("*", *lags, *((F.col(c) - F.lag(c, 1).over(w)).alias(f"{c}_mom1m") for c in columns))


def raw_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = RAW_LAGS, ties: Sequence[str] = ()) -> DataFrame:
    """Lags of raw rows, and differences over 1 and 288; ``ties`` orders rows of one time."""
    w = Window.partitionBy("deviceId").orderBy("timedate", *ties)
    out = [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in lags]
    return df.select("*", *out, *((F.col(c) - F.lag(c, k).over(w)).alias(f"{c}_mom{k}") for c in columns for k in (1, 288)))


def regimes(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Heating and cooling degrees around a threshold, their products with x1, and defrost; missing stays missing."""
    hot, cold = F.lit(threshold) - F.col("t1"), F.col("t1") - F.lit(threshold)
    hdh, cdh = clip(hot, 0.0), clip(cold, 0.0)
    return df.select("*", hdh.alias("hdh"), cdh.alias("cdh"), (F.col("x1") * hdh).alias("x1_hdh"), (F.col("x1") * cdh).alias("x1_cdh"), clip(F.col("t5") - F.col("t8"), 0.0).alias("defrost"))
