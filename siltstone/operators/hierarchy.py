"""Label DAGs: closure, depth, propagation to the fix-point, violations and repair.

Edges are (child, parent). Probabilities are long: (row_id, class, p). Label graphs are small next
to the rows, so the closure is joined to them, and every propagation is one join and one aggregate. A
closure deeper than ``MAX_DEPTH`` (a cycle) is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 64


def obo_edges(lines: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(child, parent) of ontology lines (n, line): ``id:`` opens a term, ``is_a:`` names a parent, what follows `` ! `` is dropped.

    With ``targets`` (class) only edges whose ends are both targets stay. Lines carry a file's order, which is one sequence; terms
    are told apart by a running count, so the carry-forward is by file (column ``file``, if there is one).
    """
    w = Window.partitionBy(*(["file"] if "file" in lines.columns else [F.lit(0)])).orderBy("n")
    term = F.when(F.col("line").startswith("id:"), F.trim(F.substring("line", 4, 1 << 20)))
    rows = lines.withColumn("child", F.last(term, ignorenulls=True).over(w)).where(F.col("line").startswith("is_a:"))
    edges = rows.select("child", F.trim(F.substring_index(F.substring("line", 6, 1 << 20), " ! ", 1)).alias("parent")).where("child is not null")
    if targets is not None:
        for end in ("child", "parent"):
            edges = edges.join(targets.select(F.col("class").alias(end)), end, "left_semi")
    return edges.select("child", "parent")


def adjacency(edges: DataFrame) -> DataFrame:
    """(class, parents, children), sorted lists."""
    parents = edges.groupBy(F.col("child").alias("class")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    children = edges.groupBy(F.col("parent").alias("class")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    none = F.array().cast("array<string>")
    return parents.join(children, "class", "full").select("class", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps) of every class with itself and everything above it; steps is the longest way."""
    spark = edges.sparkSession
    return spark.sql(
        f"""
        WITH RECURSIVE up(ancestor, descendant, steps) MAX RECURSION LEVEL {MAX_DEPTH} AS (
            SELECT DISTINCT c, c, 0 FROM (SELECT child AS c FROM {{e}} UNION ALL SELECT parent FROM {{e}})
            UNION ALL
            SELECT e.parent, up.descendant, up.steps + 1 FROM up JOIN {{e}} e ON e.child = up.ancestor)
        SELECT ancestor, descendant, max(steps) AS steps FROM up GROUP BY ancestor, descendant
        """,
        e=edges,
    )


def depths(edges: DataFrame) -> DataFrame:
    """(class, depth): the longest way up to a root."""
    return closure(edges).groupBy(F.col("descendant").alias("class")).agg(F.max("steps").alias("depth"))


def dag_stats(edges: DataFrame) -> DataFrame:
    d = depths(edges)
    ends = edges.agg(F.count("*").alias("edges"))
    roots = d.join(edges.select(F.col("child").alias("class")).distinct(), "class", "left_anti").agg(F.count("*").alias("roots"))
    leaves = d.join(edges.select(F.col("parent").alias("class")).distinct(), "class", "left_anti").agg(F.count("*").alias("leaves"))
    return d.agg(F.count("*").alias("classes"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth")).crossJoin(ends).crossJoin(roots).crossJoin(leaves)


def propagated(probabilities: DataFrame, edges: DataFrame, how: str) -> DataFrame:
    """(row_id, class, p): ``up`` is the maximum over descendants, ``down`` the minimum over ancestors, each with itself."""
    c = closure(edges).select("ancestor", "descendant")
    source, to, fold = ("descendant", "ancestor", F.max) if how == "up" else ("ancestor", "descendant", F.min)
    reached = probabilities.join(c, probabilities["class"] == c[source]).groupBy("row_id", F.col(to).alias("class")).agg(fold("p").alias("p"))
    mine = probabilities.select("row_id", "class", F.col("p").alias("own"))
    return mine.join(reached, ["row_id", "class"], "left").select("row_id", "class", F.coalesce("p", "own").alias("p"))


def edge_values(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_id, child, parent, p_child, p_parent) for every row and edge with both ends.

    Rows are joined to the edges by the child (Spark broadcasts them where their measured size allows it), then by row and parent."""
    child = values.join(edges, values["class"] == edges["child"]).select("row_id", "child", "parent", F.col("p").alias("p_child"))
    return child.join(values.select("row_id", F.col("class").alias("parent"), F.col("p").alias("p_parent")), ["row_id", "parent"])


def violations(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of rows with child 1 and parent 0, and the share of rows that have one (labels: row_id, class, p)."""
    bad = edge_values(labels, edges).where("p_child = 1 and p_parent = 0")
    rows = labels.agg(F.countDistinct("row_id").alias("n"))
    return bad.agg(F.count("*").alias("violations"), F.countDistinct("row_id").alias("bad")).crossJoin(rows).select("violations", F.coalesce(F.lit(100.0) * F.col("bad") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("percent_rows"))


def hierarchy_penalty(probabilities: DataFrame, edges: DataFrame) -> DataFrame:
    gap = F.col("p_child") - F.col("p_parent")
    return edge_values(probabilities, edges).agg(F.avg(F.when(gap > 0, gap).otherwise(0.0)).alias("penalty"))


def repaired(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels with every parent of a 1 set to 1."""
    return propagated(labels, edges, "up")


def compared(probabilities: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(method, violations, percent_rows) of down, up and both ways (which ends as down) after the threshold."""
    out = None
    for k, (name, how) in enumerate((("top_down", "down"), ("bottom_up", "up"), ("bidirectional", "down"))):
        hard = propagated(probabilities, edges, how).withColumn("p", (F.col("p") > threshold).cast("int"))
        one = violations(hard, edges).select(F.lit(k).alias("place"), F.lit(name).alias("method"), "violations", "percent_rows")
        out = one if out is None else out.unionAll(one)
    return out


def tie_broken(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_id, class, label) after one pass over the edges in order of (n): at a conflict (child 1, parent 0) the parent
    becomes 1 if the child's probability is greater, else the child becomes 0. values: row_id, class, p, label; edges: n, child, parent.

    The pass is sequential within a row: one ordered fold over the row's own maps."""
    ordered = F.broadcast(edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "child", "parent"))), lambda e: F.struct(e["child"].alias("c"), e["parent"].alias("p"))).alias("edges")))
    rows = values.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "p"))).alias("prob"), F.map_from_entries(F.collect_list(F.struct("class", "label"))).alias("label"))

    def step(state, e):
        conflict = (F.element_at(state, e["c"]) == 1) & (F.element_at(state, e["p"]) == 0)
        up = F.element_at("prob", e["c"]) > F.element_at("prob", e["p"])
        put = lambda key, v: F.transform_values(state, lambda k, x: F.when(k == key, F.lit(v)).otherwise(x))
        return F.when(~F.coalesce(conflict, F.lit(False)), state).when(up, put(e["p"], 1)).otherwise(put(e["c"], 0))

    return rows.crossJoin(ordered).select("row_id", F.explode(F.aggregate("edges", F.col("label"), step)).alias("class", "label"))


def messages(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """(g, node, x): each node's feature plus the features of its neighbours and of the bonds to them. nodes: g, node, x; bonds: g, u, v, w (each once)."""
    both = bonds.select("g", F.col("u").alias("node"), F.col("v").alias("other"), "w").unionAll(bonds.select("g", F.col("v").alias("node"), F.col("u").alias("other"), "w"))
    near = both.join(nodes.select("g", F.col("node").alias("other"), F.col("x").alias("_x")), ["g", "other"]).groupBy("g", "node").agg(F.sum(F.col("_x") + F.col("w")).alias("m"))
    return nodes.join(near, ["g", "node"], "left").select("g", "node", (F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x"))


def pooled(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("g").agg(F.avg("x").alias("x"))
