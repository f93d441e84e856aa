"""Baselines, expanding folds, weights, blends and dense forecast grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clip
from .stats import quantiles

KEYS = ["deviceId", "year", "month"]


def labelled(df: DataFrame) -> DataFrame:
    return df.where("target_x2 is not null")


def forecast_rows(df: DataFrame) -> DataFrame:
    return df.where("target_x2 is null")


def folds(df: DataFrame, first_valid: int) -> DataFrame:
    """(valid_ym): labelled months from ``first_valid`` on."""
    return labelled(df).where(F.col("ym") >= first_valid).select(F.col("ym").alias("valid_ym")).distinct()


def fold_rows(df: DataFrame, first_valid: int) -> DataFrame:
    """Each labelled row once per fold that it is in, with its role; folds are a few months and are broadcast."""
    months = folds(df, first_valid)
    rows = labelled(df).join(F.broadcast(months), F.col("ym") <= F.col("valid_ym"))
    return rows.withColumn("role", F.when(F.col("ym") == F.col("valid_ym"), "valid").otherwise("train"))


def device_baseline(train: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(device means, global mean over rows), each by ``by``."""
    mean = F.avg("target_x2")
    return train.groupBy(*by, "deviceId").agg(mean.alias("device_mean")), train.groupBy(*by).agg(mean.alias("global_mean"))


def with_baseline(rows: DataFrame, devices: DataFrame, overall: DataFrame) -> DataFrame:
    """``baseline``: the device's mean, or the global mean for devices that the training rows lack."""
    return rows.join(devices, "deviceId", "left").crossJoin(F.broadcast(overall)).withColumn("baseline", F.coalesce("device_mean", "global_mean")).drop("device_mean", "global_mean")


def month_means(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, *KEYS).agg(*(F.avg(c).alias(c) for c in columns))


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def baseline_cv(df: DataFrame, first_valid: int) -> DataFrame:
    """Per fold: rows, device-months, and the baseline's error by row and by month.

    A fold's training mean of a device is the running mean over its months before, so rows aren't copied
    into folds: one aggregate by device and month, one window over it, and one join back to the rows.
    """
    rows = labelled(df).select(*KEYS, "ym", "target_x2")
    per = rows.groupBy("deviceId", "ym").agg(F.sum("target_x2").alias("s"), F.count("*").alias("n"))
    past = Window.partitionBy("deviceId").orderBy("ym").rowsBetween(Window.unboundedPreceding, -1)
    devices = per.select("deviceId", "ym", (F.sum("s").over(past) / F.sum("n").over(past)).alias("device_mean"))
    # a few dozen months: their window is one small task
    months = per.groupBy("ym").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = Window.orderBy("ym").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("ym", (F.sum("s").over(before) / F.sum("n").over(before)).alias("global_mean"), F.sum("n").over(before).alias("train_rows")).where("train_rows is not null")
    valid = rows.where(F.col("ym") >= first_valid).join(devices.where(F.col("ym") >= first_valid), ["deviceId", "ym"]).join(F.broadcast(months), "ym")
    valid = valid.withColumn("baseline", F.coalesce("device_mean", "global_mean"))
    by_month = valid.groupBy("ym", *KEYS).agg(F.avg("target_x2").alias("y"), F.avg("baseline").alias("p"), F.count("*").alias("n"), F.sum(F.abs(F.col("target_x2") - F.col("baseline"))).alias("e"), F.max("train_rows").alias("t"))
    return by_month.groupBy(F.col("ym").alias("valid_ym")).agg(
        F.max("t").alias("train_rows"),
        F.sum("n").alias("valid_rows"),
        F.count("*").alias("monthly_rows"),
        mae(F.col("y"), F.col("p")).alias("baseline_monthly_mae"),
        (F.sum("e") / F.sum("n")).alias("baseline_row_mae"),
    )


def group_weight() -> Column:
    """1 / rows of the device-month."""
    return 1 / F.count("*").over(Window.partitionBy(*KEYS))


def recency(df: DataFrame, low: float = 0.8, span: float = 0.4) -> DataFrame:
    """``recency``: from low to low + span over the months; the extremes come from one aggregate."""
    ends = df.agg(F.min("ym").alias("_a"), F.max("ym").alias("_b"))
    scaled = (F.col("ym") - F.col("_a")) / F.when(F.col("_b") - F.col("_a") < 1, 1).otherwise(F.col("_b") - F.col("_a"))
    return df.crossJoin(F.broadcast(ends)).withColumn("recency", F.lit(low) + F.lit(span) * scaled).drop("_a", "_b")


def warmth(df: DataFrame, column: str, low: float = 0.7, span: float = 0.6, missing: float | None = 0.5) -> DataFrame:
    """``warmth``: from low at the 10 % quantile of a column to low + span at the 90 % quantile; a missing value counts as the share ``missing``."""
    bottom, top = quantiles(df, column, (0.1, 0.9))
    if bottom is None:
        return df.withColumn("warmth", F.lit(low) + F.lit(span) * F.lit(missing).cast("double"))
    share = clip((F.col(column) - bottom) / max(top - bottom, 1e-6), 0.0, 1.0)
    return df.withColumn("warmth", F.lit(low) + F.lit(span) * F.coalesce(share, F.lit(missing).cast("double")))


def weighted(df: DataFrame, mode: str, warm_column: str) -> DataFrame:
    """``weight``: the product of the parts that ``mode`` names, within [1e-4, 10].

    Parts are ``device_month_equal`` (1 / rows of the device-month), ``recent`` and ``warm`` (missing where the warm column is;
    no part where there is no such column); ``none`` and other names give 1."""
    mode = mode.strip().lower()
    out, parts = df, []
    if "recent" in mode:
        out, parts = recency(out), [*parts, F.col("recency")]
    if "warm" in mode and warm_column in df.columns:
        out, parts = warmth(out, warm_column, missing=None), [*parts, F.col("warmth")]
    if "device_month_equal" in mode:
        parts.append(group_weight())
    product = F.lit(1.0)
    for p in parts:
        product = product * p
    return out.withColumn("weight", clip(product, 1e-4, 10.0)).drop("recency", "warmth")


def raw_weighted(df: DataFrame, warm_column: str) -> DataFrame:
    return warmth(recency(df), warm_column).withColumn("weight", clip(F.col("recency") * F.col("warmth"), 0.2, 3.0)).drop("recency", "warmth")


def blend_grid(df: DataFrame, y: str, a: str, b: str, step: float = 0.05) -> DataFrame:
    """(w, mae) of w * a + (1 - w) * b, not below 0, for every w of the grid."""
    step = max(0.01, step)
    count = int(round(1 / step))
    w = df.sparkSession.range(count + 1).select((F.col("id") * F.lit(step)).alias("w"))
    mixed = clip(F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b), 0.0)
    return df.crossJoin(F.broadcast(w)).groupBy("w").agg(F.avg(F.abs(F.col(y) - mixed)).alias("mae"))


def best_blend(grid: DataFrame) -> DataFrame:
    """The weight with least error; ties keep w = 1, then the smaller weight."""
    key = F.struct("mae", (F.abs(F.col("w") - 1) > 1e-9).alias("other"), "w")
    return grid.agg(F.min(key).alias("k")).select(F.col("k.w").alias("w"), F.col("k.mae").alias("mae"))


def forecast_grid(devices: DataFrame, months: Sequence[tuple[int, int]]) -> DataFrame:
    """Every device with every (year, month); the months are a literal list and are broadcast."""
    table = devices.sparkSession.createDataFrame(list(months), "year int, month int")
    return devices.select("deviceId").distinct().crossJoin(F.broadcast(table))


def densified(grid: DataFrame, predictions: DataFrame, fallback: DataFrame, overall: DataFrame) -> DataFrame:
    """The grid with predictions, else the device's mean, else the global mean; never below 0."""
    out = grid.join(predictions, KEYS, "left").join(fallback, "deviceId", "left").crossJoin(F.broadcast(overall))
    return out.select(*KEYS, clip(F.coalesce("prediction", "device_mean", "global_mean"), 0.0).alias("prediction"))


def submission_check(submission: DataFrame, n_months: int) -> DataFrame:
    """One row: rows, devices, missing predictions, whether all hold."""
    out = submission.agg(F.count("*").alias("n_rows"), F.countDistinct("deviceId").alias("devices"), F.count_if(F.col("prediction").isNull()).alias("missing"), F.countDistinct("year", "month").alias("months"))
    return out.withColumn("ok", (F.col("n_rows") == F.col("devices") * n_months) & (F.col("missing") == 0) & (F.col("months") == n_months))


def final_metric(valid: Column, test: Column) -> Column:
    """Two of six months validate, four test."""
    return valid * (2 / 6) + test * (4 / 6)


def gbt_residual_predictions(train: DataFrame, rows: DataFrame, features: Sequence[str], preset: str = "fast") -> DataFrame:
    """Boosted trees with absolute error on the residual over the device baseline; ``rows`` with ``prediction``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    # fixed values: iterations, depth, rate and least rows of a leaf
    iterations, depth, rate, leaf = {"fast": (20, 5, 0.1, 30), "strong": (60, 6, 0.06, 20), "heavy": (120, 8, 0.04, 15)}[preset]
    devices, overall = device_baseline(train)
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features if c not in KEYS]
    prepare = lambda d: with_baseline(d, devices, overall).select(*KEYS, "target_x2", "baseline", *numbers)
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    learner = GBTRegressor(featuresCol="features", labelCol="residual", predictionCol="gain", lossType="absolute", maxIter=iterations, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, subsamplingRate=0.8, seed=42)
    fitted = learner.fit(assemble.transform(prepare(train).withColumn("residual", F.col("target_x2") - F.col("baseline"))))
    return fitted.transform(assemble.transform(prepare(rows))).withColumn("prediction", clip(F.col("baseline") + F.col("gain"), 0.0)).drop("features", "gain")
