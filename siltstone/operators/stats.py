"""Correlations, quantiles, classification metrics and report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clip, ratio


def unpivoted(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "class", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def correlations(df: DataFrame, columns: Sequence[str], target: str, n: int | None = None) -> DataFrame:
    """(feature, corr) with the target by absolute size; constant columns are left out. One aggregate for all columns."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.when(F.stddev_samp(c) > 0, F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias("corr")) for c in columns]
    out = df.where(F.col(target).isNotNull()).agg(F.array(*pairs).alias("a")).select(F.inline("a")).where("corr is not null")
    return out if n is None else out.orderBy(F.desc(F.abs("corr")), "feature").limit(n)


def varying(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature) whose sample deviation is above 0."""
    parts = [F.struct(F.lit(c).alias("feature"), F.stddev_samp(c).alias("std")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a")).where("std > 0")


def min_max_scaled(train: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled by the train extremes (constant ones give 0); the extremes are one row."""
    ends = train.agg(*(F.min(c).alias(f"_min_{c}") for c in columns), *(F.max(c).alias(f"_max_{c}") for c in columns))
    scaled = {c: F.coalesce(ratio(F.col(c) - F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")), F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in columns}
    return rows.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*rows.columns)


def weighted_average(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(weight))


def positive_weights(labels: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(class, weight) of long 0/1 labels (class, value): root of negatives over positives, within [1, 20]."""
    pos = F.sum("value")
    root = F.sqrt((F.count("value") - pos + epsilon) / (pos + epsilon))
    return labels.groupBy("class").agg(clip(root, 1.0, 20.0).alias("weight"))


def confusion(rows: DataFrame) -> DataFrame:
    """(class, tp, fp, fn) of long (class, y, p)."""
    return rows.groupBy("class").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn")
    )


def f1(counts: DataFrame) -> DataFrame:
    twice = F.lit(2.0) * F.col("tp")
    return counts.withColumn("f1", F.coalesce(ratio(twice, twice + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(rows: DataFrame) -> DataFrame:
    return f1(confusion(rows)).agg(F.avg("f1").alias("macro_f1"))


def focal_loss(y: Column, p: Column, weight: Column, alpha: float = 0.5, gamma: float = 1.0) -> Column:
    """Focal cross entropy of one probability: clamped, weighted where y is 1."""
    q = clip(p, 1e-6, 1 - 1e-6)
    right = F.when(y == 1, q).otherwise(1 - q)
    share = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return share * F.power(1 - right, F.lit(gamma)) * -F.ln(right) * F.when(y == 1, weight).otherwise(F.lit(1.0))


def most_common(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k most frequent values, ties by first occurrence."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def number_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    c = F.col(value)
    return df.groupBy(*by).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 1).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"))


def hit_rate(condition: Column, counted: Column | None = None) -> list[Column]:
    """hits, and their share of the rows (that ``counted`` holds for); 0.0 for none."""
    total = F.count("*") if counted is None else F.count_if(counted)
    hits = F.count_if(condition)
    return [hits.alias("hits"), F.coalesce(ratio(hits.cast("double"), total), F.lit(0.0)).alias("rate")]


def ids_where(df: DataFrame, condition: Column, order: str, by: Sequence[str]) -> DataFrame:
    """The ids of the rows of each group that a condition holds for, in order."""
    return df.where(condition).groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("ids"))


def stratified_sample(df: DataFrame, by: str, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly round-half-even(fraction * n) rows of each stratum, those of least keyed hash."""
    if fraction <= 0:
        raise ValueError("fraction must be above 0")
    if fraction >= 1:
        return df
    # 4096 equal ranges of the hash: whole ranges are taken until the one in which the number is reached, and only that one is ranked
    hashed = df.withColumn("_h", F.xxhash64(*keys, F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 52))
    upto = Window.partitionBy(by).orderBy("_b")
    counts = hashed.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    wanted = F.bround(F.col("_all") * F.lit(fraction)).cast("long")
    counts = counts.select(by, "_b", (wanted - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n").where("_left > 0")
    rows = hashed.join(counts, [by, "_b"])
    whole = rows.where("_left >= _n")
    edge = rows.where("_left < _n").withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_h", *keys))).where("_k <= _left")
    return whole.select(*df.columns).unionAll(edge.select(*df.columns))


def hash_split(df: DataFrame, keys: Sequence[str], share: float = 0.9, seed: int = 42) -> DataFrame:
    """``part``: train or valid by a keyed hash."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < int(share * 10_000), "train").otherwise("valid"))


def first_occurrences(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given (total) order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


#: Values that one task may hold for an exact quantile, and bins of a pass.
DIRECT_VALUES, BINS = 1_000_000, 4096


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; missing values don't count.

    A pass counts the values in equal bins between the bounds and goes on in the bin that holds the rank, until
    few enough values are left to rank them, so no task holds all distinct values however many there are.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n, least, most = values.agg(F.count("*"), F.min("x"), F.max("x")).first()

    def ranked(rank: int) -> float:
        low, high, before, count = least, most, 0, n
        while low < high and count > DIRECT_VALUES:
            place = F.least(F.floor((F.col("x") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            bins = values.where(F.col("x").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()
            for b in bins:  # at most BINS rows
                if rank < before + b["n"]:
                    break
                before += b["n"]
            low, high, count = b["low"], b["high"], b["n"]
        if low == high:
            return low
        return values.where(F.col("x").between(low, high)).agg(F.percentile("x", F.lit((rank - before) / (count - 1)))).first()[0]

    out: list[float | None] = []
    for p in shares:
        if not n:
            out.append(None)
            continue
        at = p * (n - 1)
        k = int(at)
        a = ranked(k)
        out.append(a if at == k else a + (ranked(k + 1) - a) * (at - k))
    return out
