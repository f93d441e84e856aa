"""Queries of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import context as C
from ..operators import hierarchy as H
from ..operators import signal as S
from ..operators import telemetry as T
from ..operators import text as X
from ..sources import readers
from . import signal_queries, telemetry_queries, text_queries
from . import views as V
from .common import Registry, d6, r6

R = Registry()

for _new, _old, _of in (
    ("agg_build", "agg_build_d", telemetry_queries.R),
    ("math_sqrt", "math_sqrt_pow", telemetry_queries.R),
    ("math_pow", "math_sqrt_pow", telemetry_queries.R),
    ("flt_offset", "flt_offset_limit", telemetry_queries.R),
    ("flt_limit", "flt_offset_limit", telemetry_queries.R),
    ("flt_kind", "src_text", text_queries.R),
    ("math_hist", "math_diff_hist", signal_queries.R),
):
    R.add(_new, _of.sql[_old])(_of.queries[_old])


@R.add("prj_deltas_mean", d6(V.with_views("SELECT deviceId, coalesce(sum(t2),0)/count(*) - coalesce(sum(t1),0)/count(*) AS delta_t2_t1 FROM tel GROUP BY deviceId, date_trunc('day', timedate)", "tel"), "delta_t2_t1"))
def prj_deltas_mean(s, d):
    return r6(T.time_features(V.tel(s, d), "D", ["t1", "t2"]).select("deviceId", "delta_t2_t1"))


@R.add("topk_clamp", "SELECT asked, CAST(least(greatest(asked, 1), 60) AS INT) AS files, CAST(least(greatest(asked, 1), 8) AS INT) AS matches FROM (VALUES (0), (5), (100)) t(asked)")
def topk_clamp(s, d):
    rows = s.createDataFrame([(0,), (5,), (100,)], "asked int")
    clamp = lambda most: F.least(F.greatest("asked", F.lit(1)), F.lit(most))
    return rows.select("asked", clamp(60).alias("files"), clamp(8).alias("matches"))


@R.add("dt_fmt_dur", "SELECT o_orderkey, printf('%02d:%02d:%02d', o_custkey*97//3600, (o_custkey*97//60)%60, (o_custkey*97)%60) AS t FROM orders")
def dt_fmt_dur(s, d):
    return V.table(s, d, "orders").select("o_orderkey", dates.duration(F.col("o_custkey") * 97).alias("t"))


@R.add("math_diff", d6(V.with_views("SELECT vec_id, CAST(i AS INT) AS i, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM emb", "emb"), "d"))
def math_diff(s, d):
    return r6(V.emb(s, d).select("vec_id", "i", (F.col("v") - F.lag("v").over(S.along())).alias("d")))


@R.add("math_linspace", d6("SELECT CAST(k AS INT) AS k, -1 + k*2.0::DOUBLE/10 AS x FROM range(11) t(k)", "x"))
def math_linspace(s, d):
    return r6(s.range(11).select(F.col("id").cast("int").alias("k"), (F.lit(-1.0) + F.col("id") * 2.0 / 10).alias("x")))


@R.add("math_rng")
def math_rng(s, d):
    """Seeded normal numbers, by a hash of the row so that they don't depend on partitions."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return s.range(1000).select("id", (F.sqrt(-2 * F.ln(u(1))) * F.cos(F.lit(S.TURN) * u(2))).alias("x"))


@R.add("json_round", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def json_round(s, d):
    c = V.table(s, d, "conversations")
    row = F.to_json(F.struct("role", F.struct("text").alias("body")))
    return c.select("conv_id", "turn", row.alias("j")).select("conv_id", "turn", F.get_json_object("j", "$.role").alias("role"), F.char_length(F.get_json_object("j", "$.body.text")).cast("long").alias("chars"))


@R.add("src_locate", "SELECT count(*) AS n FROM orders")
def src_locate(s, d):
    """The folder that is found, by what it holds."""
    return s.read.parquet(readers.locate(s, [f"{d}/nowhere", d], "orders.parquet") + "/orders.parquet").agg(F.count("*").alias("n"))


def _lines(s, d):
    return X.lines(V.doc(s, d), ["doc_id"])


@R.add("ctx_locate")
def ctx_locate(s, d):
    """Where the lines 2 to 6 of the longest document stand in all documents."""
    longest = V.doc(s, d).select(F.max_by("text", F.struct(F.size(F.split("text", "\n")), "doc_id")).alias("t")).first()["t"].split("\n")
    return C.locate(_lines(s, d), longest[1:6], ["doc_id"], F.lit(2))


_EXP = ", ".join(f"coalesce(sum(length(line)+1) FILTER (abs(n-5) <= {k // 2}), 0) AS s{k}" for k in (4, 8, 16, 32))


@R.add("ctx_expand", V.with_views(f"WITH {text_queries._LINES}, z AS (SELECT doc_id, {_EXP} FROM ln GROUP BY 1) SELECT doc_id, CAST(CASE WHEN s4 >= 2000 THEN 4 WHEN s8 >= 2000 THEN 8 WHEN s16 >= 2000 THEN 16 ELSE 32 END AS INT) AS step, CAST(CASE WHEN s4 >= 2000 THEN s4 WHEN s8 >= 2000 THEN s8 WHEN s16 >= 2000 THEN s16 ELSE s32 END AS BIGINT) AS chars FROM z", "doc"))
def ctx_expand(s, d):
    return C.expanded(_lines(s, d), ["doc_id"], F.lit(5), 2000, (4, 8, 16, 32))


R.add("ctx_quality_floor", R.sql["ctx_expand"])(ctx_expand)


@R.add("ctx_add")
def ctx_add(s, d):
    """Buffers per source after adding its documents in order."""
    calls = V.doc(s, d).select("source", F.col("doc_id").alias("n"), "path", F.lit(1).alias("start"), F.col("text").alias("content"))
    return C.replayed(calls, "source", 12_000).select("source", F.char_length("context").alias("chars"))


_BONDS = "b AS (SELECT DISTINCT l_orderkey AS g, l_partkey % 7 AS u, l_suppkey % 7 AS v FROM lineitem WHERE l_partkey % 7 < l_suppkey % 7), nd AS (SELECT DISTINCT g, node, CAST(node AS DOUBLE) AS x FROM (SELECT g, u AS node FROM b UNION ALL SELECT g, v FROM b))"


@R.add("graph_message", d6(f"WITH {_BONDS}, e AS (SELECT g, u AS a, v AS o FROM b UNION ALL SELECT g, v, u FROM b), m AS (SELECT e.g, a, sum(x + 0.5::DOUBLE) AS m FROM e JOIN nd ON nd.g = e.g AND nd.node = e.o GROUP BY ALL) SELECT nd.g, avg(x + coalesce(m, 0)) AS x FROM nd LEFT JOIN m ON m.g = nd.g AND m.a = nd.node GROUP BY 1", "x"))
def graph_message(s, d):
    b = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 7).alias("u"), (F.col("l_suppkey") % 7).alias("v")).where("u < v").distinct().withColumn("w", F.lit(0.5))
    nodes = b.select("g", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("x", F.col("node").cast("double"))
    return r6(H.pooled(H.messages(nodes, b)))
