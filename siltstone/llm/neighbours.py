"""Approximate nearest neighbours by collision-counting hashing (operator 8).

Every vector is projected on ``PROJECTIONS`` random lines; each line is one sorted array, and a
vector's hash there is its place. A query opens on every line the window of values
within ``W * R`` of its own and counts, for each vector, the lines on which it lies in
the window. Growing R (virtual rehashing: the arrays stay as they are) makes the
windows grow: the places that are new on either side are walked and counted, so
a place is visited once for a query, whatever the number of radii; windows that have become so wide that most places lie in
them are counted by comparing all places with their ends, which gives the same counts. At radius R, a vector within distance R
collides on a share of at least erf(W / sqrt 2) of the lines, so those with nearly that many
collisions are verified by their true inner product. A query ends when its k-th best verified vector is
within R. Windows end up covering everything, so a query always gets its k.

Inner products become distances by one more coordinate that gives all vectors the
same norm (queries have zero there).

Vectors and queries are dealt into blocks by row, whatever their ids and however often a vector is
repeated; each pair of a query block and a vector block is one task of bounded memory, and gives at
most k rows a query. Vectors that are null, zero, or hold null or non-finite components take no
part; neither do those without a vec_id. Vectors of different lengths have no inner product: each length is searched among
its own. Rows that repeat a vec_id are candidates and queries each; a row is never its own neighbour. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PROJECTIONS, W, K, SEED = 128, 1.0, 20, 11
#: How many standard deviations below the expected collisions a vector is still verified.
SLACK = 1.3
RADII = (0.1, 0.3, 0.6, 0.85, 1.0, 1.08, 1.16, 1.24, 1.32, 1.42, 1.6, 2.1)
#: A place that is walked costs as much as comparing so many. Every how many vectors one is in the sample that chooses the first radius. Vectors that are compared, and queries that are prepared, at a time.
WALK, SAMPLE, TILE, STEP = 32, 16, 16384, 2048
#: Most rows of a block of either side; a block has this many vectors at least, unless there are fewer.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS = 65536, 16384, 16384

_OUT = "row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the embedding unchanged) of the vectors that take part."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~bad & F.exists("v", lambda x: x != 0))


class Lines:
    """A block of vectors as one sorted array for each line."""

    def __init__(self, x: np.ndarray, longest: float) -> None:
        self.n, dim = x.shape
        self.lines = np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))
        unit = x / longest
        tail = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        values = (unit @ self.lines[:-1] + tail[:, None] * self.lines[-1]).astype(np.float32).T
        self.order = np.argsort(values, axis=1).astype(np.int32)
        self.values = np.take_along_axis(values, self.order, 1)
        self.place = np.empty((PROJECTIONS, self.n), np.uint16)
        np.put_along_axis(self.place, self.order, np.broadcast_to(np.arange(self.n, dtype=np.uint16), self.place.shape), 1)

    def windows(self, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of queries begin and end on every line (queries x lines, twice), each at its own radius."""
        low, high = np.empty(centre.shape, np.int32), np.empty(centre.shape, np.int32)
        reach = W * radius
        for j, line in enumerate(self.values):
            low[:, j] = np.searchsorted(line, (centre[:, j] - reach).astype(np.float32), "left")
            high[:, j] = np.searchsorted(line, (centre[:, j] + reach).astype(np.float32), "right")
        return low, high

    def walked(self, low: np.ndarray, high: np.ndarray, since_low: np.ndarray, since_high: np.ndarray) -> np.ndarray:
        """Collisions in the places by which windows have grown, on both sides of every line."""
        sides = [o[a:b] for o, a, b in zip(self.order, low.tolist(), since_low.tolist(), strict=True) if a < b]
        sides += [o[a:b] for o, a, b in zip(self.order, since_high.tolist(), high.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(sides), minlength=self.n) if sides else np.zeros(self.n, np.int64)

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions in whole windows, by comparing places: dearer than a walk unless windows are wide."""
        out = np.empty(self.n, np.uint8)
        width = high - low
        every = width > 65535  # such a window has all places, and its width no 16 bits
        first, wide = low.astype(np.uint16)[:, None], np.where(every, 0, width).astype(np.uint16)[:, None]
        for a in range(0, self.n, TILE):
            inside = (self.place[:, a : a + TILE] - first) < wide
            np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8, out=out[a : a + TILE])
        return out + np.uint8(every.sum())


def search_block(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, longest: float, k: int = K) -> pd.DataFrame:
    """The k verified best of a block for each query, by (inner product, smaller id)."""
    index = Lines(x, longest)
    n, m = index.n, PROJECTIONS
    share = math.erf(W / math.sqrt(2))
    need = math.floor(m * share - SLACK * math.sqrt(m * share * (1 - share)))
    norms = np.linalg.norm(q, axis=1)
    # inner products in single precision rank what is verified; those that may be among the k best are taken in double
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    doubt = 4e-7 * x.shape[1] * norms * longest
    own = np.argsort(rows, kind="stable")
    at_own = own[np.minimum(np.searchsorted(rows[own], query_rows), n - 1)]
    radii, out, some = np.array(RADII), [], x32[::SAMPLE]
    for i in range(len(q)):
        if i % STEP == 0:
            now = slice(i, i + STEP)
            centre = (q[now] / norms[now, None]) @ index.lines[:-1]
            near = some @ q32[now].T
            near[rows[::SAMPLE, None] == query_rows[None, now]] = -np.inf
            apart = 2.0 - 2.0 * near.max(axis=0) / (norms[now] * longest)
            # radii within which not even one vector of a sample lies are passed over: they seldom hold k, and what they would show, the next radius does
            begins = np.searchsorted(radii[:-1] ** 2, apart)
            lows, highs = index.windows(centre, radii[begins])
        done = np.zeros(n, bool)
        done[at_own[i]] = rows[at_own[i]] == query_rows[i]
        found, scores, count = [], [], 0
        for r in range(begins[i % STEP], len(radii)):
            if r + 1 == len(radii):
                new = np.flatnonzero(~done)
            else:
                if r == begins[i % STEP]:
                    low, high = lows[i % STEP], highs[i % STEP]
                    old_low = old_high = low
                else:
                    old_low, old_high = low, high
                    low, high = (w[0] for w in index.windows(centre[i % STEP, None], radii[r : r + 1]))
                if int((high - low).sum(dtype=np.int64) - (old_high - old_low).sum(dtype=np.int64)) * WALK < m * n:
                    count = count + index.walked(low, high, old_low, old_high)
                else:
                    count = index.within(low, high).astype(np.int64)
                new = np.flatnonzero((count >= need) & ~done)
            if len(new):
                done[new] = True
                found.append(new)
                scores.append(x32[new] @ q32[i])
            if sum(map(len, found)) >= k:
                s = np.concatenate(scores)
                kth = np.partition(s, len(s) - k)[len(s) - k]
                if 2.0 - 2.0 * kth / (norms[i] * longest) <= radii[r] ** 2:
                    break
        if found:
            at, s = np.concatenate(found), np.concatenate(scores)
            if len(at) > k:
                at = at[s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * doubt[i]]
            s = (x[at] * q[i]).sum(axis=1)
            top = np.lexsort((ids[at], -s))[:k]
            out.append((np.full(len(top), i), ids[at[top]], s[top]))
    if not out:
        return pd.DataFrame({c: np.array([], float if c == "score" else np.int64) for c in ("row", "query_id", "vec_id", "score")})
    i, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"row": query_rows[i], "query_id": query_ids[i], "vec_id": vec, "score": score})


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # written once, so that a row has one number whoever reads it
    v = common.materialize(usable(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("d"), norm.alias("norm")), "vectors")
    n, longest, queries = v.agg(F.count("*"), F.max("norm"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # blocks of bounded rows, and enough of them to keep the cluster busy
    busy = max(1, spark.sparkContext.defaultParallelism)
    blocks = max(-(-n // BLOCK_ROWS), min(busy, -(-n // LEAST_ROWS)))
    query_blocks = -(-queries // QUERY_ROWS)

    def dealt(rows: DataFrame, own: str, into: int, other: str, copies: int) -> DataFrame:
        """Each row in one block of its own side, once for every block of the other."""
        one = F.pmod(F.xxhash64("row"), F.lit(into)).cast("int").alias(own)
        return rows.select("row", "vec_id", "v", "d", one, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    data = dealt(v, "b", blocks, "c", query_blocks)
    asked = dealt(v.where(F.col("vec_id") % every == 0), "c", query_blocks, "b", blocks)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.array([], float if c == "score" else np.int64) for c in ("row", "query_id", "vec_id", "score")})
        (rows, ids, x), (query_rows, query_ids, q) = ((f["row"].to_numpy(np.int64), f["vec_id"].to_numpy(np.int64), np.stack(f["v"].to_numpy()).astype(float)) for f in (left, right))
        return search_block(rows, ids, x, query_rows, query_ids, q, longest, k)

    part = data.groupBy("d", "b", "c").cogroup(asked.groupBy("d", "b", "c")).applyInPandas(solve, _OUT)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
