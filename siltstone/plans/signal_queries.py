"""Queries of one-dimensional signals, sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as S
from ..sources import readers, schemas, sinks
from ..streaming.buckets import bucket_stream, written
from . import views as V
from .common import Registry, d6, r6, scratch

R = Registry()


def _e(name: str, sql: str, doubles: list[str], make):
    text = V.with_views(sql, "emb")
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(V.emb(s, d))))


_INT = lambda sql, *cs: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in cs)}) FROM ({sql})"
_SM = lambda w: f"sum(v) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)/{w}"
_e("sig_smooth", f"SELECT vec_id, CAST(i AS INT) AS i, {_SM(5)} AS smooth FROM emb", ["smooth"], lambda x: S.smoothed(x, 5).select("vec_id", "i", "smooth"))
_e("sig_diffabs", "WITH m AS (SELECT vec_id, median(v) AS m FROM emb GROUP BY 1), c AS (SELECT vec_id, i, v-m AS c FROM emb JOIN m USING (vec_id)) SELECT vec_id, CAST(i AS INT) AS i, abs(c - lag(c) OVER (PARTITION BY vec_id ORDER BY i)) AS step FROM c", ["step"], lambda x: S.centred_steps(x).select("vec_id", "i", "step"))
_AC = "c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM emb), ac AS (SELECT a.vec_id, CAST(b.i - a.i AS INT) AS lag, sum(a.c*b.c) AS ac FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 4 AND 35 GROUP BY ALL)"
_e("sig_autocorr", f"WITH {_AC} SELECT vec_id, lag, ac FROM ac", ["ac"], lambda x: S.autocorrelation(x))
_e("math_argminmax", f"WITH {_AC}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ac DESC, lag) AS k FROM ac) SELECT vec_id, lag FROM r WHERE k = 1", [], lambda x: S.best_lag(S.autocorrelation(x)))
_FFT = "f AS (SELECT vec_id, k, sqrt(power(sum(c*cos(2*pi()*k*i/64)),2)+power(sum(c*sin(2*pi()*k*i/64)),2)) AS m FROM (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM emb), range(1, 17) t(k) GROUP BY ALL)"
_e("sig_fft_period", f"WITH {_FFT} SELECT vec_id, 64.0::DOUBLE/arg_max(k, m) AS period FROM f GROUP BY 1", ["period"], lambda x: S.fft_period(x.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("v"))))
_RUN = "h AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM emb WHERE v > 0)"
_e("sig_runs", f"WITH {_RUN} SELECT vec_id, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM h GROUP BY vec_id, g", [], lambda x: S.runs(x, F.col("v") > 0))
R.add("win_islands", R.sql["sig_runs"])(R.queries["sig_runs"])
_POS = f"sm AS (SELECT vec_id, i, {_SM(9)} AS s FROM emb), tp AS (SELECT *, max(s) OVER (PARTITION BY vec_id) AS t FROM sm), hh AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM tp WHERE s >= t*0.35::DOUBLE), po AS (SELECT vec_id, (min(i)+max(i))/2.0::DOUBLE AS position FROM hh GROUP BY vec_id, g)"
_e("sig_line_pos", f"WITH {_POS} SELECT vec_id, position FROM po", ["position"], lambda x: S.line_positions(x))
_MODAL = "bb AS (SELECT *, least(floor((d-lo)/CASE WHEN hi > lo THEN hi-lo ELSE 1.0 END*32), 31) AS b FROM gg), ct AS (SELECT vec_id, b, count(*) AS n FROM bb GROUP BY ALL), md AS (SELECT vec_id, b FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, b) AS k FROM ct) WHERE k = 1)"
_e("sig_spacing", f"WITH {_POS}, dd AS (SELECT vec_id, position - lag(position) OVER (PARTITION BY vec_id ORDER BY position) AS d FROM po), gg AS (SELECT vec_id, d, min(d) OVER (PARTITION BY vec_id) AS lo, max(d) OVER (PARTITION BY vec_id) AS hi FROM dd WHERE d > 2 AND d < 500), {_MODAL} SELECT bb.vec_id, median(d) AS spacing FROM bb JOIN md ON bb.vec_id = md.vec_id AND bb.b = md.b GROUP BY 1", ["spacing"], lambda x: S.spacing(S.line_positions(x)))
_e("sig_phase", f"WITH {_POS}, gg AS (SELECT vec_id, fmod(position, 7.0) AS d, 0.0::DOUBLE AS lo, 7.0::DOUBLE AS hi FROM po), {_MODAL} SELECT bb.vec_id, median(d) AS phase FROM bb JOIN md ON bb.vec_id = md.vec_id AND bb.b = md.b GROUP BY 1", ["phase"], lambda x: S.phase(S.line_positions(x), 7.0))
_PAIR = "p AS (SELECT vec_id, max(v) FILTER (i = 0) AS a, max(v) FILTER (i = 1) AS b FROM emb GROUP BY 1)"
_pair = lambda x: x.groupBy("vec_id").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("b"))
_e("sig_fuse", f"WITH {_PAIR} SELECT vec_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a-b)/nullif(greatest(abs(a),abs(b)),0) < 0.15 THEN (a+b)/2 ELSE a END AS f FROM p", ["f"], lambda x: _pair(x).select("vec_id", S.fused(F.col("a"), F.col("b")).alias("f")))
_e("sig_confidence", f"WITH {_PAIR} SELECT vec_id, least(1, greatest(0, CASE WHEN a > 0 THEN 0.6 ELSE 0 END + CASE WHEN b > 0 THEN 0.5 ELSE 0 END + CASE WHEN a < b THEN -0.2 ELSE 0 END)) AS c FROM p", ["c"], lambda x: _pair(x).select("vec_id", S.confidence([(F.col("a") > 0, 0.6), (F.col("b") > 0, 0.5), (F.col("a") < F.col("b"), -0.2)]).alias("c")))
_e("sig_sanitize", f"WITH {_PAIR}, z AS (SELECT vec_id, abs(a)*40+0.5 AS v FROM p), k AS (SELECT vec_id, v*f AS x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(ln(v*f/5.0)), j) AS r FROM z, (VALUES (0,1.0::DOUBLE),(1,0.2),(2,5.0),(3,0.5),(4,2.0)) t(j,f)) SELECT vec_id, x FROM k WHERE r = 1", ["x"], lambda x: _pair(x).select("vec_id", S.sane_spacing(F.abs("a") * 40 + 0.5, F.lit(5.0)).alias("x")))
_e("sig_robust_angle", "WITH m AS (SELECT vec_id, median(v*10) AS m FROM emb GROUP BY 1), o AS (SELECT vec_id, v*10 AS v, abs(v*10-m) AS o FROM emb JOIN m USING (vec_id)), q AS (SELECT vec_id, median(o) AS mad FROM o GROUP BY 1), n AS (SELECT o.* FROM o JOIN q USING (vec_id) WHERE o <= greatest(1.5, mad*2.5)) SELECT vec_id, median(v) AS angle, quantile_cont(v,0.9)-quantile_cont(v,0.1) AS spread, count(*) AS n, count(*) >= 3 AND quantile_cont(v,0.9)-quantile_cont(v,0.1) <= 6.0 AS accepted FROM n GROUP BY 1", ["angle", "spread"], lambda x: S.robust_angle(x.withColumn("v", F.col("v") * 10)))
_e("sig_baseline", "WITH m AS (SELECT vec_id, median(v) AS m FROM emb GROUP BY 1) SELECT vec_id, CAST(i AS INT) AS i, least(5, greatest(-5, (v-m)*30)) AS flat FROM emb JOIN m USING (vec_id)", ["flat"], lambda x: S.baseline_removed(x, scale=30.0).select("vec_id", "i", "flat"))
_e("math_cummax", "SELECT vec_id, CAST(i AS INT) AS i, max(v) OVER (PARTITION BY vec_id ORDER BY i) AS m FROM emb", ["m"], lambda x: x.select("vec_id", "i", F.max("v").over(S.along()).alias("m")))
_e("math_diff_hist", "SELECT vec_id, CAST(least(floor((v+1)*8), 15) AS BIGINT) AS bin, count(*) AS n FROM emb GROUP BY ALL", [], lambda x: x.groupBy("vec_id", F.least(F.floor((F.col("v") + 1) * 8), F.lit(15)).alias("bin")).agg(F.count("*").alias("n")))
_e("sig_window_layout", "SELECT DISTINCT vec_id, CAST(floor((vec_id % 50 + 10)*0.25::DOUBLE) AS INT) AS a, CAST(floor((vec_id % 50 + 10)*0.5::DOUBLE) AS INT) AS b, CAST(vec_id % 50 + 10 AS INT) AS z FROM emb", [], lambda x: x.select("vec_id", S.window_layout(F.col("vec_id") % 50 + 10, [1, 1, 2]).alias("w")).distinct().select("vec_id", F.get("w", F.lit(1)).alias("a"), F.get("w", F.lit(2)).alias("b"), F.get("w", F.lit(3)).alias("z")))
_e("sig_valley", f"WITH sm AS (SELECT vec_id, i, {_SM(5)} AS s FROM emb), r AS (SELECT vec_id, CAST(seam AS INT) AS seam, i, row_number() OVER (PARTITION BY vec_id, seam ORDER BY s, i) AS k FROM sm JOIN (VALUES (16),(32),(48)) t(seam) ON abs(i-seam) <= 5) SELECT vec_id, seam, CAST(i AS INT) AS place FROM r WHERE k = 1", [], lambda x: S.valleys(x, [16, 32, 48], 5))
_e("sig_pulse", f"WITH {_PAIR} SELECT vec_id, least(1.4, greatest(0.7, 0.5*(1.0::DOUBLE/nullif(abs(a)*4,0))+0.5)) AS scale FROM p", ["scale"], lambda x: _pair(x).select("vec_id", S.pulse_scale(F.abs("a") * 4, 1.0).alias("scale")))


def _arrays(s, d):
    return V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@R.add("sig_resample", d6("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), k AS (SELECT vec_id, a, CAST(unnest(range(20)) AS BIGINT) AS k FROM e), x AS (SELECT vec_id, k, a, k*63.0::DOUBLE/19 AS x FROM k) SELECT vec_id, CAST(k AS INT) AS k, a[CAST(floor(x) AS BIGINT)+1] + (a[least(CAST(floor(x) AS BIGINT)+1, 63)+1] - a[CAST(floor(x) AS BIGINT)+1])*(x-floor(x)) AS v FROM x", "v"))
def sig_resample(s, d):
    return r6(_arrays(s, d).select("vec_id", F.posexplode(S.resampled(F.col("v"), 20)).alias("k", "v")))


@R.add("sig_nms")
def sig_nms(s, d):
    return _arrays(s, d).select("vec_id", F.posexplode(S.peaks(F.col("v"))).alias("k", "place"))


@R.add("sig_trace_nn")
def sig_trace_nn(s, d):
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.filter(F.slice("v", k * 8 + 1, 8), lambda x: x > 0))
    return r6(_arrays(s, d).select("vec_id", F.posexplode(S.traced(columns)).alias("x", "y")))


@R.add("sig_viterbi")
def sig_viterbi(s, d):
    picture = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8))
    return S.viterbi(_arrays(s, d).select("vec_id", picture.alias("picture"))).select("vec_id", F.posexplode("path").alias("x", "y"))


@R.add("sig_remap", "SELECT vec_id AS record, CASE label % 3 WHEN 0 THEN 'II' WHEN 1 THEN 'V1' ELSE 'X' END AS lead FROM embeddings")
def sig_remap(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("record"), F.when(F.col("label") % 3 == 0, "a").when(F.col("label") % 3 == 1, "b").otherwise("X").alias("lead"), F.col("embedding").alias("v"))
    pairs = readers.lead_map(s.createDataFrame([("a", "ii"), ("b", "v1"), ("c", "zz")], "source string, lead string"), ["I", "II", "V1"])
    return S.remapped(e, pairs).select("record", "lead")


R.add("src_remap", R.sql["sig_remap"])(sig_remap)


@R.add("sig_default", d6("SELECT vec_id AS record, l AS lead, CASE WHEN (label % 2 = 0) = (l = 'I') THEN list_sum(embedding) ELSE 0 END AS total FROM embeddings, (VALUES ('I'), ('II')) t(l)", "total"))
def sig_default(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("record"), F.when(F.col("label") % 2 == 0, "I").otherwise("II").alias("lead"), F.col("embedding").alias("v"))
    return r6(S.default_leads(e, ["I", "II"], 64).select("record", "lead", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


@R.add("snk_npz", d6("SELECT concat_ws('_', vec_id, 'II') AS key, list_sum(embedding) AS total FROM embeddings", "total"))
def snk_npz(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("record"), F.lit("II").alias("lead"), F.col("embedding").alias("v"))
    path = scratch(s, "signals")
    sinks.signal_archive(e, path)
    return r6(s.read.parquet(path).select("key", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


# sources and sinks: written by a sink, read back by a source

_TELCSV = "SELECT deviceId, timedate, t1, x1 FROM tel"


def _written(s, d):
    path = scratch(s, "telemetry")
    t = V.tel(s, d)
    for c in schemas.telemetry().names:
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("float"))
    sinks.csv(t.select(*schemas.telemetry().names), path)
    return path


@R.add("src_csv_chunk", d6(V.with_views("SELECT deviceId, count(*) AS n, sum(CAST(t1 AS FLOAT)) AS t1, sum(CAST(x1 AS FLOAT)) AS x1 FROM tel GROUP BY 1", "tel"), "t1", "x1"))
def src_csv_chunk(s, d):
    x = readers.csv(s, _written(s, d), schemas.telemetry(), ["deviceId", "t1", "x1"])
    return r6(x.groupBy("deviceId").agg(F.count("*").alias("n"), F.sum(F.col("t1").cast("double")).alias("t1"), F.sum(F.col("x1").cast("double")).alias("x1")))


@R.add("src_csv_full", V.with_views("SELECT count(*) AS n, count(x2) AS labelled, count(DISTINCT deviceId) AS devices FROM tel", "tel"))
def src_csv_full(s, d):
    x = readers.csv(s, _written(s, d), schemas.telemetry())
    return x.agg(F.count("*").alias("n"), F.count("x2").alias("labelled"), F.countDistinct("deviceId").alias("devices"))


@R.add("src_csv_feat", V.with_views("SELECT deviceId, count(*) AS days FROM (SELECT deviceId, date_trunc('day', timedate) AS d, count(x2) AS c FROM tel GROUP BY ALL) WHERE c > 0 GROUP BY 1", "tel"))
def src_csv_feat(s, d):
    from ..operators.telemetry import time_features

    path = scratch(s, "features")
    sinks.csv(time_features(V.tel(s, d), "D", ["t1", "x1"]), path)
    return readers.feature_csv(s, path, labelled_only=True).groupBy("deviceId").agg(F.count("*").alias("days"))


@R.add("snk_csv", "SELECT count(*) AS n FROM orders")
def snk_csv(s, d):
    path = scratch(s, "orders")
    sinks.csv(V.table(s, d, "orders"), path, single=True)
    return s.read.option("header", True).csv(path).agg(F.count("*").alias("n"))


@R.add("src_parquet", "SELECT column_name AS class FROM (DESCRIBE labels) WHERE column_name <> 'doc_id'")
def src_parquet(s, d):
    x = readers.parquet(s, f"{d}/labels.parquet")
    return s.createDataFrame([(c,) for c in readers.class_columns(x, ["doc_id"])], "class string")


@R.add("snk_parquet", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def snk_parquet(s, d):
    path = scratch(s, "orders")
    sinks.parquet(V.table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return s.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _datapoints(s, d):
    path = scratch(s, "datapoints")
    x = V.doc(s, d).select(F.col("doc_id").cast("string").alias("id"), "source", F.lit("r1").alias("revision"), "path", F.array(F.col("path")).alias("modified"), F.col("text").alias("prefix"), F.lit("").alias("suffix"))
    sinks.json_lines(x.withColumnRenamed("source", "repo"), path, ["id"])
    return path


@R.add("src_jsonl", "SELECT source AS repo, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def src_jsonl(s, d):
    x = readers.json_lines(s, _datapoints(s, d), schemas.DATAPOINTS)
    return x.groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.char_length("prefix").cast("long")).alias("chars"))


R.add("snk_jsonl", R.sql["src_jsonl"])(src_jsonl)


@R.add("src_jsonl_count", "SELECT count(*) AS n FROM documents")
def src_jsonl_count(s, d):
    return s.createDataFrame([(readers.json_line_count(s, _datapoints(s, d)),)], "n long")


@R.add("src_corpus", "SELECT count(DISTINCT source) AS files, CAST(sum(octet_length(encode(text)))+count(*) AS BIGINT) AS bytes FROM documents")
def src_corpus(s, d):
    """A tree of text files (one folder a source) and its listing."""
    path = scratch(s, "corpus")
    V.table(s, d, "documents").select("source", "text").repartition(4, "source").write.partitionBy("source").text(path)
    files = readers.corpus(s, path, "*.txt")
    return files.agg(F.countDistinct(F.regexp_extract("path", "source=([^/]+)", 1)).alias("files"), F.sum("size").alias("bytes"))


@R.add("src_image")
def src_image(s, d):
    path = scratch(s, "pictures")
    s.range(4).select(F.lit("x").alias("value")).write.text(path)
    return readers.images(s, path, 10).select("path", "size")


@R.add("snk_cache", "SELECT count(*) AS n FROM customer")
def snk_cache(s, d):
    path = scratch(s, "cache")
    make = lambda: V.table(s, d, "customer").select("c_custkey", "c_name")
    sinks.cached(s, path, ["c_custkey", "c_name"], make)
    return sinks.cached(s, path, ["c_custkey", "c_name"], make).agg(F.count("*").alias("n"))


@R.add("stream_buckets", d6(V.with_views("SELECT deviceId, time_bucket(INTERVAL '6 hours', timedate, TIMESTAMP '1970-01-01') AS date, count(*) AS n_rows, CAST(count(*) FILTER (x1 > 0) AS DOUBLE)/count(*) AS active_ratio, coalesce(sum(t1),0)/count(*) AS t1_mean, min(t1) AS t1_min, max(t1) AS t1_max FROM tel GROUP BY ALL", "tel"), "active_ratio", "t1_mean", "t1_min", "t1_max"))
def stream_buckets(s, d):
    """The batch bucket table from a stream of the same rows (an extension)."""
    source, out, state = scratch(s, "stream"), scratch(s, "buckets"), scratch(s, "state")
    V.tel(s, d).select("deviceId", "timedate", "t1", "x1").write.parquet(source)
    stream = s.readStream.schema("deviceId string, timedate timestamp_ntz, t1 double, x1 double").parquet(source)
    return r6(written(bucket_stream(stream, "6h", ["t1"], "400 days"), out, state))
