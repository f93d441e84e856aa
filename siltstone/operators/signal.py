"""Kernels over one-dimensional signals, long (vec_id, i, v) or as array<double> per row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clip


def along(by: str = "vec_id") -> Window:
    return Window.partitionBy(by).orderBy("i")


def smoothed(df: DataFrame, width: int) -> DataFrame:
    """``smooth``: box filter of odd width at least 3, with zeros beyond the ends."""
    width = max(3, width | 1)
    return df.withColumn("smooth", F.sum("v").over(along().rowsBetween(-(width // 2), width // 2)) / width)


def centred_steps(df: DataFrame) -> DataFrame:
    """``step``: absolute first differences of the signal less its median."""
    middle = df.groupBy("vec_id").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return df.join(middle, "vec_id").withColumn("c", F.col("v") - F.col("m")).withColumn("step", F.abs(F.col("c") - F.lag("c").over(along()))).drop("m")


def autocorrelation(df: DataFrame, low: int = 4, high: int = 35) -> DataFrame:
    """(vec_id, lag, ac) of the centred signal; each lag is a window offset, not a self join."""
    mean = df.withColumn("c", F.col("v") - F.avg("v").over(Window.partitionBy("vec_id")))
    terms = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("c") * F.lead("c", k).over(along())).alias("x")) for k in range(low, high + 1)))
    return mean.select("vec_id", terms.alias("t")).select("vec_id", F.inline("t")).where("x is not null").groupBy("vec_id", "lag").agg(F.sum("x").alias("ac"))


def best_lag(ac: DataFrame) -> DataFrame:
    """The lag of greatest autocorrelation, the smaller one of equals."""
    return ac.groupBy("vec_id").agg(F.max_by("lag", F.struct("ac", -F.col("lag"))).alias("lag"))


def fft_period(df: DataFrame, low: float = 4, high: float = 200, flat: float = 1e-6) -> DataFrame:
    """(vec_id, period) of the strongest frequency whose period lies within [low, high]; NULL for a flat signal. df: vec_id, v (array)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f["v"]:
                x = np.asarray(v, float)
                n = len(x)
                k = np.arange(1, n // 2 + 1)
                k = k[(n / k >= low) & (n / k <= high)] if n else k
                if not len(k) or x.std() < flat:
                    out.append(None)
                    continue
                size = np.abs(np.fft.rfft(x - x.mean()))[k]
                out.append(float(n / k[int(np.argmax(size))]))
            yield pd.DataFrame({"vec_id": f["vec_id"], "period": pd.Series(out, dtype=float)})

    return df.select("vec_id", "v").mapInPandas(run, "vec_id long, period double")


def runs(df: DataFrame, condition: Column) -> DataFrame:
    """(vec_id, first, last) of consecutive places where a condition holds."""
    hit = df.where(condition).select("vec_id", "i").withColumn("g", F.col("i") - F.row_number().over(along()))
    return hit.groupBy("vec_id", "g").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("g")


def line_positions(df: DataFrame, width: int = 9, share: float = 0.35) -> DataFrame:
    """(vec_id, position): middles of the runs in which the smoothed signal is at least a share of its maximum."""
    s = smoothed(df, width).withColumn("top", F.max("smooth").over(Window.partitionBy("vec_id")))
    return runs(s, F.col("smooth") >= F.col("top") * share).select("vec_id", ((F.col("first") + F.col("last")) / 2).alias("position"))


def modal_bin(df: DataFrame, value: str, bins: int, low: Column, high: Column) -> DataFrame:
    """Rows of the fullest of equal bins between low and high (the last bin is closed), the first of equals. df has vec_id, value."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    place = F.least(F.floor((F.col(value) - low) / span * bins), F.lit(bins - 1))
    binned = df.withColumn("_b", place)
    full = binned.groupBy("vec_id", "_b").agg(F.count("*").alias("n")).groupBy("vec_id").agg(F.max_by("_b", F.struct("n", -F.col("_b"))).alias("_m"))
    return binned.join(full, "vec_id").where("_b = _m").drop("_b", "_m")


def spacing(positions: DataFrame, low: float = 2, high: float = 500, bins: int = 32) -> DataFrame:
    """(vec_id, spacing): the median difference of positions in the fullest bin."""
    w = Window.partitionBy("vec_id").orderBy("position")
    gaps = positions.withColumn("d", F.col("position") - F.lag("position").over(w)).where((F.col("d") > low) & (F.col("d") < high))
    ends = gaps.groupBy("vec_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return modal_bin(gaps.join(ends, "vec_id"), "d", bins, F.col("lo"), F.col("hi")).groupBy("vec_id").agg(F.percentile("d", F.lit(0.5)).alias("spacing"))


def phase(positions: DataFrame, period: float, bins: int = 32) -> DataFrame:
    """(vec_id, phase): the median of positions modulo a period in the fullest bin."""
    m = positions.withColumn("d", F.pmod(F.col("position"), F.lit(float(period))))
    return modal_bin(m, "d", bins, F.lit(0.0), F.lit(float(period))).groupBy("vec_id").agg(F.percentile("d", F.lit(0.5)).alias("phase"))


def fused(a: Column, b: Column, tolerance: float = 0.15) -> Column:
    """The mean of two estimates that agree within a tolerance, else the first; the other one where one is missing."""
    near = F.abs(a - b) / F.nullif(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)) < tolerance
    return F.when(a.isNull(), b).when(b.isNull(), a).when(near, (a + b) / 2).otherwise(a)


def confidence(parts: list[tuple[Column, float]]) -> Column:
    """The sum of the scores whose conditions hold, within [0, 1]."""
    total = F.lit(0.0)
    for condition, score in parts:
        total = total + F.when(condition, F.lit(score)).otherwise(F.lit(0.0))
    return clip(total, 0.0, 1.0)


#: Factors by which a spacing may have been mistaken.
FACTORS = (1.0, 0.2, 5.0, 0.5, 2.0)


def sane_spacing(value: Column, expected: Column) -> Column:
    """The value times the factor that brings it nearest to what is expected (by the logarithm of the ratio; the first of equals)."""
    choices = F.array(*(F.struct(F.abs(F.ln(value * f / expected)).alias("d"), F.lit(k).alias("k"), (value * f).alias("x")) for k, f in enumerate(FACTORS)))
    return F.when((value > 0) & (expected > 0), F.array_min(choices)["x"])


def robust_angle(df: DataFrame, by: str = "vec_id", value: str = "v") -> DataFrame:
    """Median, spread (p90 - p10) and number of the values within max(1.5, 2.5 MAD) of the median, and whether they are accepted."""
    middle = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    off = df.join(middle, by).withColumn("off", F.abs(F.col(value) - F.col("m")))
    mad = off.groupBy(by).agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    inner = off.join(mad, by).where(F.col("off") <= F.greatest(F.lit(1.5), F.col("mad") * 2.5))
    out = inner.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("angle"), (F.percentile(value, F.lit(0.9)) - F.percentile(value, F.lit(0.1))).alias("spread"), F.count("*").alias("n"))
    return out.withColumn("accepted", (F.col("n") >= 3) & (F.col("spread") <= 6.0))


def peaks(v: Column, count: int = 4, distance: int = 8) -> Column:
    """Greedy peaks of an array: the highest first (the earlier of equals), none nearer than ``distance`` to one taken; sorted places."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    start = F.array().cast("array<int>")

    def take(got: Column, e: Column) -> Column:
        near = F.exists(got, lambda p: F.abs(p - e["i"]) < distance)
        return F.when((F.size(got) >= count) | near, got).otherwise(F.array_append(got, e["i"].cast("int")))

    return F.array_sort(F.aggregate(order, start, take))


def traced(candidates: Column) -> Column:
    """Of each column's candidate heights (array of arrays) the one nearest to the last taken; an empty column carries it on."""
    state = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<double>").alias("path"))

    def step(s: Column, c: Column) -> Column:
        nearest = F.array_min(F.transform(c, lambda y: F.struct(F.abs(y - F.coalesce(s["at"], y)).alias("d"), y.alias("y"))))["y"]
        at = F.coalesce(nearest, s["at"])
        return F.struct(at.alias("at"), F.array_append(s["path"], at).alias("path"))

    return F.aggregate(candidates, state, step, lambda s: s["path"])


def viterbi(df: DataFrame, states: int = 20) -> DataFrame:
    """(vec_id, path): the best way through a picture (array of columns of darkness) by emission and step costs; one task per record."""

    def best(picture: list) -> list[int]:
        grid = np.stack([np.asarray(c, float) for c in picture])
        height = grid.shape[1]
        rows = np.arange(height)
        emit = 0.85 * grid - 0.15 * np.abs(rows - (height - 1) / 2) / max(1.0, height / 2)
        kept = [np.sort(np.argsort(-e, kind="stable")[:states]) for e in emit]
        score, back = emit[0][kept[0]], []
        for x in range(1, len(grid)):
            move = score[None, :] - 0.25 * np.abs(kept[x][:, None] - kept[x - 1][None, :]) / max(5.0, 0.1 * height)
            back.append(move.argmax(axis=1))
            score = move.max(axis=1) + emit[x][kept[x]]
        k = int(score.argmax())
        path = [int(kept[-1][k])]
        for x in range(len(grid) - 2, -1, -1):
            k = int(back[x][k])
            path.append(int(kept[x][k]))
        return path[::-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "path": [best(p) if len(p) else [] for p in f["picture"]]})

    return df.select("vec_id", "picture").mapInPandas(run, "vec_id long, path array<int>")


def baseline_removed(df: DataFrame, width: int | None = None, scale: float = 1.0, limit: float = 5.0) -> DataFrame:
    """``flat``: the signal less its median (of a running window of odd width, if given), scaled and clipped."""
    if width is None:
        middle = df.groupBy("vec_id").agg(F.percentile("v", F.lit(0.5)).alias("m"))
        based = df.join(middle, "vec_id")
    else:
        half = width // 2
        based = df.withColumn("m", F.percentile("v", F.lit(0.5)).over(along().rowsBetween(-half, half)))
    return based.withColumn("flat", clip((F.col("v") - F.col("m")) * scale, -limit, limit)).drop("m")


def resampled(v: Column, n: int) -> Column:
    """An array at n even places by linear interpolation."""
    size = F.size(v)
    at = lambda k: F.lit(0.0) if n == 1 else k * (size - 1).cast("double") / (n - 1)

    def one(k: Column) -> Column:
        x = at(k)
        low = F.floor(x).cast("int")
        high = F.least(low + 1, size - 1)
        return F.get(v, low) + (F.get(v, high) - F.get(v, low)) * (x - low)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


def window_layout(width: Column, ratios: list[float]) -> Column:
    """Starts of parts of a width by ratios, strictly increasing."""
    total, edges = sum(ratios), [0.0]
    for r in ratios:
        edges.append(edges[-1] + r)
    raw = F.array(*(F.floor(width * (e / total)).cast("int") for e in edges))
    rise = lambda a, x: F.array_append(a, F.greatest(x, F.coalesce(F.get(a, F.size(a) - 1) + 1, x)))
    return F.aggregate(raw, F.array().cast("array<int>"), rise)


def valleys(df: DataFrame, seams: list[int], guard: int) -> DataFrame:
    """(vec_id, seam, place): the least smoothed value within ``guard`` of each seam, the first of equals."""
    s = smoothed(df, 5)
    table = df.sparkSession.createDataFrame([(x,) for x in seams], "seam int")
    near = s.join(F.broadcast(table), F.abs(F.col("i") - F.col("seam")) <= guard)
    return near.groupBy("vec_id", "seam").agg(F.min_by("i", F.struct("smooth", "i")).alias("place"))


def pulse_scale(height: Column, expected: float, blend: float = 0.5) -> Column:
    """Scale of a calibration pulse, blended with 1 and within [0.7, 1.4]."""
    return clip(blend * (F.lit(expected) / F.nullif(height, F.lit(0.0))) + (1 - blend), 0.7, 1.4)


def default_leads(signals: DataFrame, leads: list[str], length: int) -> DataFrame:
    """Every record with every lead; absent ones are zeros. signals: record, lead, v (array<float>)."""
    table = signals.sparkSession.createDataFrame([(x,) for x in leads], "lead string")
    grid = signals.select("record").distinct().crossJoin(F.broadcast(table))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), length)
    return grid.join(signals, ["record", "lead"], "left").select("record", "lead", F.coalesce("v", zeros).alias("v"))


def remapped(signals: DataFrame, mapping: DataFrame) -> DataFrame:
    """Leads renamed by (source, lead) rows; those without one keep their name."""
    return signals.join(mapping.withColumnRenamed("lead", "new"), F.upper(signals["lead"]) == F.upper(F.col("source")), "left").select("record", F.coalesce("new", "lead").alias("lead"), "v")


TURN = 2 * math.pi
