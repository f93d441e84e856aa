"""Connected components by alternating star joins, without one row, node or star on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node that it reaches.

    Each round is a large star (every larger neighbour of a node is linked to the
    node's least neighbour) and a small star (every smaller-or-equal neighbour is), each
    a minimum per node and a join with it. All edges end as (node, root) after a
    logarithmic number of rounds. The tables are written to the shared folder between
    rounds. Edges with a null end are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a != b")
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: every edge goes from its larger end, which also links its smaller neighbours
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        small = common.materialize(small, "edges")
        state = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        common.drop_scratch(edges)
        edges = small
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components not found in {rounds} rounds")
