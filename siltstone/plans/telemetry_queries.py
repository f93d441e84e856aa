"""Queries of telemetry, windows and forecasting, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, nulls
from ..operators import enrich, forecast, stats
from ..operators import telemetry as T
from . import views as V
from .common import Registry, d6, r6

R = Registry()
COLS = ["t1", "t2", "t5", "t8", "x1"]
MCOLS = ["t1", "t5", "t8", "x1"]
FREQS = {"d": ("D", "1 day"), "12h": ("12h", "12 hours"), "6h": ("6h", "6 hours"), "3h": ("3h", "3 hours"), "1h": ("1h", "1 hour"), "30min": ("30min", "30 minutes")}


def _moments_sql(c: str) -> str:
    return f"""coalesce(sum({c}),0)/count(*) AS {c}_mean,
 sqrt(greatest(0, coalesce(sum({c}*{c}),0)/count(*) - power(coalesce(sum({c}),0)/count(*), 2))) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max"""


def _bucket_sql(width: str, cols: list[str]) -> str:
    deltas = ", ".join(f"{a}_mean - {b}_mean AS delta_{a}_{b}" for a, b in T.MEAN_DELTAS if a in cols and b in cols)
    pi = "pi()"
    return f"""SELECT deviceId, date, period, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(dayofyear(date) AS INT) AS dayofyear,
 CAST(isodow(date)-1 AS INT) AS weekday, CAST(hour(date) AS INT) AS hour, CAST(minute(date) AS INT) AS minute, CAST(isodow(date) >= 6 AS INT) AS is_weekend,
 sin(2*{pi}*dayofyear(date)/366) AS doy_sin, cos(2*{pi}*dayofyear(date)/366) AS doy_cos,
 sin(2*{pi}*(hour(date)*60+minute(date))/1440) AS tod_sin, cos(2*{pi}*(hour(date)*60+minute(date))/1440) AS tod_cos,
 deviceType, x3, n_rows, active_ratio, {", ".join(f"{c}_{m}" for c in cols for m in ("mean", "std", "min", "max"))}{", " + deltas if deltas else ""}, target_x2
 FROM (SELECT deviceId, time_bucket(INTERVAL '{width}', timedate, TIMESTAMP '1970-01-01') AS date, arg_min(period, timedate) AS period, max(deviceType) AS deviceType, max(x3) AS x3,
 count(*) AS n_rows, CAST(count(*) FILTER (x1 > 0) AS DOUBLE)/count(*) AS active_ratio, {", ".join(map(_moments_sql, cols))}, sum(x2)/nullif(count(x2),0) AS target_x2
 FROM tel WHERE timedate IS NOT NULL AND deviceId IS NOT NULL GROUP BY ALL)"""


def _bucket_doubles(cols: list[str]) -> list[str]:
    d = ["doy_sin", "doy_cos", "tod_sin", "tod_cos", "active_ratio", "target_x2"]
    d += [f"{c}_{m}" for c in cols for m in ("mean", "std", "min", "max")]
    return d + [f"delta_{a}_{b}" for a, b in T.MEAN_DELTAS if a in cols and b in cols]


def _bucket(freq: str):
    return lambda s, d: r6(T.time_features(V.tel(s, d), freq, COLS))


for _k, (_f, _w) in FREQS.items():
    R.add(f"agg_build_{_k}", d6(V.with_views(_bucket_sql(_w, COLS), "tel"), *_bucket_doubles(COLS)))(_bucket(_f))
R.add("agg_bucket_finish", R.sql["agg_build_6h"])(_bucket("6h"))

_STATE = [f"{c}_{m}" for c in COLS for m in ("sum", "sq", "min", "max")]
_STATE_SQL = ", ".join(f"coalesce(sum({c}),0) AS {c}_sum, coalesce(sum({c}*{c}),0) AS {c}_sq, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in COLS)


def _partial_sql(width: str) -> str:
    return d6(
        V.with_views(
            f"""SELECT deviceId, time_bucket(INTERVAL '{width}', timedate, TIMESTAMP '1970-01-01') AS date, arg_min(period, timedate) AS period, max(deviceType) AS deviceType, max(x3) AS x3, count(*) AS n_rows,
 count(*) FILTER (x1 > 0) AS active_sum, coalesce(sum(x2),0) AS x2_sum, count(x2) AS x2_count, {_STATE_SQL} FROM tel GROUP BY ALL""",
            "tel",
        ),
        "x2_sum",
        *_STATE,
    )


@R.add("agg_bucket_partial", _partial_sql("1 hour"))
def agg_bucket_partial(s, d):
    p = T.bucket_partials(V.tel(s, d), "1h", COLS)
    return r6(p.withColumn("period", F.col("first_period.period")).drop("first_period"))


@R.add("agg_bucket_final", _partial_sql("1 day"))
def agg_bucket_final(s, d):
    """Days from the states of two halves of the data."""
    t = V.tel(s, d)
    halves = T.bucket_partials(t.where("event_id % 2 = 0"), "D", COLS).unionByName(T.bucket_partials(t.where("event_id % 2 = 1"), "D", COLS))
    p = T.merge_partials(halves)
    return r6(p.withColumn("period", F.col("first_period.period")).drop("first_period"))


_MD = [("delta_t5_t1", "t5", "t1"), ("lift_t5_t1", "t5", "t1")]
_MASKS = {"night": "daypart = 0", "morning": "daypart = 1", "afternoon": "daypart = 2", "evening": "daypart = 3", "cold": "t1 < 0.35", "warm": "t1 >= 0.55", "weekend": "isodow(timedate) >= 6"}
_MALL = [*MCOLS, "lift_t5_t1", "delta_t8_t1", "lift_t8_t1"]
_MROWS = "m AS (SELECT *, CAST(floor(hour(timedate)/6) AS INT) AS daypart, t5 - t1 AS lift_t5_t1, t8 - t1 AS delta_t8_t1, t8 - t1 AS lift_t8_t1 FROM mtel)"
_MSTATE = ", ".join(f"coalesce(sum({c}),0) AS {c}_sum, coalesce(sum({c}*{c}),0) AS {c}_sq, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in _MALL)
_MMASK = ", ".join(f"count(*) FILTER ({m}) AS {k}_rows, " + ", ".join(f"coalesce(sum({c}) FILTER ({m}),0) AS {k}_{c}_sum" for c in MCOLS) for k, m in _MASKS.items())
_MPARTIAL = f"""WITH {_MROWS} SELECT deviceId, CAST(year(timedate) AS INT) AS year, CAST(month(timedate) AS INT) AS month, max(deviceType) AS deviceType, max(x3) AS x3, count(*) AS n_rows,
 count(*) FILTER (x1 > 0) AS active_sum, coalesce(sum(x2),0) AS x2_sum, count(x2) AS x2_count, {_MSTATE}, {_MMASK} FROM m GROUP BY ALL"""
_MPD = ["x2_sum", *(f"{c}_{m}" for c in _MALL for m in ("sum", "sq", "min", "max")), *(f"{k}_{c}_sum" for k in _MASKS for c in MCOLS)]


@R.add("agg_month_partial", d6(V.with_views(_MPARTIAL, "mtel"), *_MPD))
def agg_month_partial(s, d):
    return r6(T.month_partials(V.mtel(s, d), MCOLS))


@R.add("agg_month_final", R.sql["agg_month_partial"])
def agg_month_final(s, d):
    m = V.mtel(s, d)
    return r6(T.merge_months(T.month_partials(m.where("x3 <= 3"), MCOLS).unionByName(T.month_partials(m.where("x3 > 3"), MCOLS))))


_MFINISH = f"""WITH p AS ({{p}}) SELECT deviceId, year, month, CAST(year*100+month AS INT) AS ym, sin(2*pi()*month/12) AS month_sin, cos(2*pi()*month/12) AS month_cos, deviceType, x3, n_rows, active_sum/n_rows AS active_ratio,
 {", ".join(f"{k}_rows/n_rows AS {k}_share" for k in _MASKS)},
 {", ".join(f"{c}_sum/n_rows AS {c}_mean, sqrt(greatest(0,{c}_sq/n_rows - power({c}_sum/n_rows,2))) AS {c}_std, {c}_min, {c}_max" for c in _MALL)},
 {", ".join(f"{k}_{c}_sum/nullif({k}_rows,0) AS {k}_{c}_mean" for k in _MASKS for c in MCOLS)}, x2_sum/nullif(x2_count,0) AS target_x2 FROM p"""
_MFD = ["month_sin", "month_cos", "active_ratio", "target_x2", *(f"{k}_share" for k in _MASKS), *(f"{c}_{m}" for c in _MALL for m in ("mean", "std", "min", "max")), *(f"{k}_{c}_mean" for k in _MASKS for c in MCOLS)]


@R.add("agg_month_finish", d6(_MFINISH.format(p=V.with_views(_MPARTIAL, "mtel")), *_MFD))
def agg_month_finish(s, d):
    return r6(T.monthly_features(V.mtel(s, d)))


_DAILY = _bucket_sql("1 day", COLS)


@R.add("agg_summary", V.with_views(f"WITH f AS ({_DAILY}) SELECT period, year, month, count(DISTINCT deviceId) AS devices, count(*) AS rows FROM f GROUP BY ALL", "tel"))
def agg_summary(s, d):
    return T.period_summary(T.time_features(V.tel(s, d), "D", COLS))


# scalar expressions


def _project(name: str, sql: str, doubles: list[str], make):
    """A projection of tel, per event."""
    text = V.with_views(sql, "tel")
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(V.tel(s, d))))


_project("prj_active", "SELECT event_id, CASE WHEN x1 > 0 THEN 1 ELSE 0 END AS active FROM tel", [], lambda t: T.with_flags(t).select("event_id", "active"))
_project("prj_x2_parts", "SELECT event_id, coalesce(x2, 0.0) AS x2_filled, CAST(x2 IS NOT NULL AS INT) AS x2_count FROM tel", ["x2_filled"], lambda t: T.with_flags(t).select("event_id", "x2_filled", "x2_count"))
_project("prj_square", "SELECT event_id, t1*t1 AS t1_sq, t5*t5 AS t5_sq FROM tel", ["t1_sq", "t5_sq"], lambda t: t.select("event_id", (F.col("t1") * F.col("t1")).alias("t1_sq"), (F.col("t5") * F.col("t5")).alias("t5_sq")))
_project("prj_deltas_raw", "SELECT event_id, t2-t1 AS delta_t2_t1, t8-t1 AS delta_t8_t1, t5-t1 AS lift_t5_t1, t8-t1 AS lift_t8_t1 FROM tel", ["delta_t2_t1", "delta_t8_t1", "lift_t5_t1", "lift_t8_t1"], lambda t: t.select("event_id", *T.raw_deltas(t)))
_project("prj_flags", "SELECT event_id, CASE WHEN t1 < 0.35 THEN 1 ELSE 0 END AS cold, CASE WHEN t1 >= 0.55 THEN 1 ELSE 0 END AS warm, CAST(isodow(timedate) >= 6 AS INT) AS weekend FROM tel", [], lambda t: T.with_flags(t).select("event_id", "cold", "warm", "weekend"))
_project("prj_daypart", "SELECT event_id, CAST(floor(hour(timedate)/6) AS INT) AS daypart FROM tel", [], lambda t: T.with_flags(t).select("event_id", "daypart"))
_project(
    "prj_regime",
    """SELECT event_id, CASE WHEN 0.55-t1 < 0 THEN 0 ELSE 0.55-t1 END AS hdh, CASE WHEN t1-0.55 < 0 THEN 0 ELSE t1-0.55 END AS cdh, x1*(CASE WHEN 0.55-t1 < 0 THEN 0 ELSE 0.55-t1 END) AS x1_hdh,
 x1*(CASE WHEN t1-0.55 < 0 THEN 0 ELSE t1-0.55 END) AS x1_cdh, CASE WHEN t5-t8 < 0 THEN 0 ELSE t5-t8 END AS defrost FROM tel""",
    ["hdh", "cdh", "x1_hdh", "x1_cdh", "defrost"],
    lambda t: enrich.regimes(t).select("event_id", "hdh", "cdh", "x1_hdh", "x1_cdh", "defrost"),
)
_project("prj_prepare", "SELECT event_id, CAST(CAST(coalesce(t2,0) AS FLOAT) AS DOUBLE) AS t2, CAST(CAST(coalesce(x1,0) AS FLOAT) AS DOUBLE) AS x1 FROM tel", ["t2", "x1"], lambda t: t.select("event_id", nulls.finite_or_zero(F.col("t2")).alias("t2"), nulls.finite_or_zero(F.col("x1")).alias("x1")))
_project("prj_prepare_cat", "SELECT event_id, coalesce(CAST(nullif(deviceType, 3) AS VARCHAR), 'NA') AS deviceType, CAST(t2 AS FLOAT) AS t2 FROM tel", ["t2"], lambda t: t.select("event_id", F.coalesce(F.nullif("deviceType", F.lit(3)).cast("string"), F.lit("NA")).alias("deviceType"), F.col("t2").cast("float").alias("t2")))
_project("prj_ym", "SELECT event_id, CAST(year(timedate)*100+month(timedate) AS INT) AS ym FROM tel", [], lambda t: t.select("event_id", dates.year_month(F.year("timedate"), F.month("timedate")).alias("ym")))
_project("prj_clip0", "SELECT event_id, CASE WHEN t1 - 0.5 < 0 THEN 0 ELSE t1 - 0.5 END AS p FROM tel", ["p"], lambda t: t.select("event_id", nulls.clip(F.col("t1") - 0.5, 0.0).alias("p")))
_project("prj_threshold", "SELECT event_id, CAST(t1 > 0.5277 AS INT) AS y FROM tel", [], lambda t: t.select("event_id", (F.col("t1") > 0.5277).cast("int").alias("y")))
_project("prj_sigmoid", "SELECT event_id, 1/(1+exp(-t1)) AS p FROM tel", ["p"], lambda t: t.select("event_id", (1 / (1 + F.exp(-F.col("t1")))).alias("p")))
_project(
    "prj_gate_blend", "SELECT event_id, (1-t8)*t1 + t8*t5 AS p, abs(t1-t5) AS gap, (t1+t5)/2 AS mid FROM tel", ["p", "gap", "mid"], lambda t: t.select("event_id", ((1 - F.col("t8")) * F.col("t1") + F.col("t8") * F.col("t5")).alias("p"), F.abs(F.col("t1") - F.col("t5")).alias("gap"), ((F.col("t1") + F.col("t5")) / 2).alias("mid"))
)
_project("math_sqrt_pow", "SELECT event_id, sqrt(t1) AS a, t1*t1 AS b, power(1-t1, 2.0) AS c FROM tel", ["a", "b", "c"], lambda t: t.select("event_id", F.sqrt("t1").alias("a"), (F.col("t1") * F.col("t1")).alias("b"), F.power(1 - F.col("t1"), F.lit(2.0)).alias("c")))
_project("math_trig", "SELECT event_id, sin(t1) AS a, cos(t1) AS b, degrees(atan2(t1, t5)) AS c, sqrt(t1*t1+t5*t5) AS d FROM tel", ["a", "b", "c", "d"], lambda t: t.select("event_id", F.sin("t1").alias("a"), F.cos("t1").alias("b"), F.degrees(F.atan2("t1", "t5")).alias("c"), F.hypot("t1", "t5").alias("d")))
_project("math_log", "SELECT event_id, ln(t1+1) AS a, abs(ln((t1+1)/2)) AS b FROM tel", ["a", "b"], lambda t: t.select("event_id", F.ln(F.col("t1") + 1).alias("a"), F.abs(F.ln((F.col("t1") + 1) / 2)).alias("b")))
_project("math_abs", "SELECT event_id, abs(t1 - t5) AS a FROM tel", ["a"], lambda t: t.select("event_id", F.abs(F.col("t1") - F.col("t5")).alias("a")))
_project("math_clip", "SELECT event_id, CASE WHEN x1 < 0.5 THEN 0.5 WHEN x1 > 20 THEN 20 ELSE x1 END AS a FROM tel", ["a"], lambda t: t.select("event_id", nulls.clip(F.col("x1"), 0.5, 20.0).alias("a")))
_project("math_int", "SELECT event_id, CAST(trunc(x1) AS INT) AS a, CAST(floor(event_id/7) AS BIGINT) AS b FROM tel", [], lambda t: t.select("event_id", F.col("x1").cast("int").alias("a"), F.floor(F.col("event_id") / 7).alias("b")))
_project("math_round", "SELECT event_id, CAST(round_even(event_id * 0.5::DOUBLE, 0) AS DOUBLE) AS a FROM tel", ["a"], lambda t: t.select("event_id", F.bround(F.col("event_id") * F.lit(0.5)).alias("a")))
_project("math_mod", "SELECT event_id, fmod(fmod(x1 - 5.0, 3.0) + 3.0, 3.0) AS a FROM tel", ["a"], lambda t: t.select("event_id", F.pmod(F.col("x1") - 5.0, F.lit(3.0)).alias("a")))
_project("dt_floor", "SELECT event_id, time_bucket(INTERVAL '30 minutes', timedate, TIMESTAMP '1970-01-01') AS b30, time_bucket(INTERVAL '3 hours', timedate, TIMESTAMP '1970-01-01') AS b180 FROM tel", [], lambda t: t.withColumn("b30", dates.floor_time(F.col("timedate"), "30min")).withColumn("b180", dates.floor_time(F.col("timedate"), "3h")).select("event_id", "b30", "b180"))
_project(
    "dt_parts",
    "SELECT event_id, CAST(year(timedate) AS INT) AS year, CAST(month(timedate) AS INT) AS month, CAST(dayofyear(timedate) AS INT) AS dayofyear, CAST(isodow(timedate)-1 AS INT) AS weekday, CAST(hour(timedate) AS INT) AS hour, CAST(minute(timedate) AS INT) AS minute, CAST(isodow(timedate) >= 6 AS INT) AS is_weekend FROM tel",
    [],
    lambda t: t.select("event_id", *(c.alias(n) for n, c in dates.calendar(F.col("timedate")).items())),
)
_project("dt_cyclic", "SELECT event_id, sin(2*pi()*month(timedate)/12) AS s, cos(2*pi()*month(timedate)/12) AS c FROM tel", ["s", "c"], lambda t: t.select("event_id", dates.cyclic(F.month("timedate"), 12)[0].alias("s"), dates.cyclic(F.month("timedate"), 12)[1].alias("c")))
_project(
    "dt_parse", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', timedate) END AS t FROM tel", [], lambda t: t.select("event_id", dates.parse_time(F.when(F.col("event_id") % 5 != 0, F.date_format("timedate", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time")).alias("t"))
)
_project("flt_valid_ts", "SELECT event_id FROM tel WHERE event_id % 5 <> 0", [], lambda t: t.where(dates.parse_time(F.when(F.col("event_id") % 5 != 0, F.col("timedate").cast("string")).otherwise("?")).isNotNull()).select("event_id"))


@R.add("dt_freq_norm", "SELECT freq, CAST(coalesce(nullif(regexp_extract(freq, '^[0-9]+'), ''), '1') AS BIGINT) * CASE lower(regexp_extract(freq, '[A-Za-z]+')) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'min' THEN 60 END AS seconds FROM (VALUES ('D'), ('d'), ('12h'), ('6H'), ('1h'), ('30min'), ('30MIN')) t(freq)")
def dt_freq_norm(s, d):
    return s.createDataFrame([(f, dates.freq_seconds(f)) for f in ("D", "d", "12h", "6H", "1h", "30min", "30MIN")], "freq string, seconds long")


@R.add("prj_geo", d6(V.with_views("SELECT *, sqrt(latitude*latitude+longitude*longitude) AS geo_r, latitude+longitude AS geo_sum, latitude-longitude AS geo_diff FROM (SELECT DISTINCT deviceId FROM tel) LEFT JOIN dev USING (deviceId)", "tel", "dev"), "latitude", "longitude", "geo_r", "geo_sum", "geo_diff"))
def prj_geo(s, d):
    return r6(enrich.with_geo(V.tel(s, d).select("deviceId").distinct(), V.dev(s, d)))


_F6 = _bucket_sql("1 day", COLS)
_ROW = [f"{c}_mean" for c in ("t1", "t5", "x1")] + ["active_ratio", "target_x2"]


@R.add("join_geo", d6(V.with_views(f"WITH f AS ({_F6}) SELECT deviceId, date, t1_mean, latitude, longitude FROM f LEFT JOIN dev USING (deviceId)", "tel", "dev"), "t1_mean", "latitude", "longitude"))
def join_geo(s, d):
    return r6(enrich.with_geo(T.time_features(V.tel(s, d), "D", COLS), V.dev(s, d)).select("deviceId", "date", "t1_mean", "latitude", "longitude"))


@R.add("prj_ratio", d6(V.with_views("SELECT deviceId, CAST(count(*) FILTER (x1 > 0) AS DOUBLE)/count(*) AS active_ratio, CAST(count(*) FILTER (t1 < 0.35) AS DOUBLE)/count(*) AS cold_share FROM tel GROUP BY 1", "tel"), "active_ratio", "cold_share"))
def prj_ratio(s, d):
    f = T.with_flags(V.tel(s, d)).groupBy("deviceId").agg((F.sum("active") / F.count("*")).alias("active_ratio"), (F.sum("cold") / F.count("*")).alias("cold_share"))
    return r6(f)


@R.add("prj_minmax", d6(V.with_views("WITH e AS (SELECT min(t1) AS a, max(t1) AS b, min(x1) AS c, max(x1) AS d FROM tel WHERE period = 'train') SELECT event_id, (t1-a)/nullif(b-a,0) AS t1, (x1-c)/nullif(d-c,0) AS x1 FROM tel, e WHERE period <> 'train'", "tel"), "t1", "x1"))
def prj_minmax(s, d):
    t = V.tel(s, d)
    return r6(stats.min_max_scaled(t.where("period = 'train'"), t.where("period <> 'train'").select("event_id", "t1", "x1"), ["t1", "x1"]))


@R.add("prj_select_feats")
def prj_select_feats(s, d):
    f = T.time_features(V.tel(s, d), "D", COLS)
    calendar_parts = {"year", "month", "dayofyear", "weekday", "hour", "minute"}
    keep = [c for c in f.columns if c not in {"deviceId", "date", "period", "target_x2"} | calendar_parts and not c.endswith("_month_inter")]
    return s.createDataFrame([(i, c) for i, c in enumerate(keep)], "n int, feature string")


# windows on the daily table


def _daily_window(name: str, sql_exprs: dict[str, str], make, columns=("t1_mean", "x1_mean", "month")):
    sql = f"WITH f AS ({_F6}) SELECT deviceId, date, {', '.join(f'{e} AS {n}' for n, e in sql_exprs.items())} FROM f WINDOW w AS (PARTITION BY deviceId ORDER BY date)"
    R.add(name, d6(V.with_views(sql, "tel"), *sql_exprs))(lambda s, d: r6(T.time_features(V.tel(s, d), "D", COLS).select("deviceId", "date", *columns).select("deviceId", "date", *make())))


_past = lambda k: f"OVER (PARTITION BY deviceId ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
_daily_window("win_lag", {f"{c}_lag{k}": f"lag({c},{k}) OVER w" for c in ("t1_mean", "x1_mean") for k in enrich.LAGS}, lambda: enrich.lagged(["t1_mean", "x1_mean"]))
_daily_window("win_roll", {f"{c}_roll{k}": f"avg({c}) {_past(k)}" for c in ("t1_mean", "x1_mean") for k in enrich.ROLLS}, lambda: enrich.rolling(["t1_mean", "x1_mean"]))
_daily_window("win_mom", {f"{c}_mom{k}": f"{c} - lag({c},{k}) OVER w" for c in ("t1_mean", "x1_mean") for k in (1, 7)}, lambda: enrich.momentum(["t1_mean", "x1_mean"]))
_EXPAND = {k: v for c in ("t1_mean", "x1_mean") for k, v in ((f"{c}_hist", f"avg({c}) {_past('UNBOUNDED')}"), (f"{c}_dev_center", f"{c} - avg({c}) {_past('UNBOUNDED')}"), (f"{c}_month_inter", f"{c}*month"))}
_daily_window("win_expand", _EXPAND, lambda: enrich.expanding(["t1_mean", "x1_mean"]))
_W4 = ["t1_mean", "t5_mean", "x1_mean", "active_ratio"]
_ENRICH = {f"{c}_lag{k}": f"lag({c},{k}) OVER w" for c in _W4 for k in enrich.LAGS} | {f"{c}_roll{k}": f"avg({c}) {_past(k)}" for c in _W4 for k in enrich.ROLLS} | {f"{c}_mom{k}": f"{c} - lag({c},{k}) OVER w" for c in _W4 for k in (1, 7)} | _EXPAND
_ENRICH_SQL = f"WITH f AS ({_F6}) SELECT deviceId, date, {', '.join(_W4)}, latitude, longitude, {', '.join(f'{e} AS {n}' for n, e in _ENRICH.items())} FROM f LEFT JOIN dev USING (deviceId) WINDOW w AS (PARTITION BY deviceId ORDER BY date)"


@R.add("win_enrich", d6(V.with_views(_ENRICH_SQL, "tel", "dev"), *_W4, "latitude", "longitude", *_ENRICH))
def win_enrich(s, d):
    f = T.time_features(V.tel(s, d), "D", COLS).select("deviceId", "date", "month", *_W4)
    return r6(enrich.enriched(f, V.dev(s, d), _W4, ["t1_mean", "x1_mean"]).drop("month", "geo_r", "geo_sum", "geo_diff"))


_MT = f"SELECT deviceId, ym, t1_mean, x1_mean FROM ({_MFINISH.format(p=V.with_views(_MPARTIAL, 'mtel'))})"


@R.add("win_lag_month", d6(f"SELECT deviceId, ym, {', '.join(f'lag({c},{k}) OVER w AS {c}_lag{k}m' for c in ('t1_mean', 'x1_mean') for k in (1, 2))}, {', '.join(f'{c} - lag({c},1) OVER w AS {c}_mom1m' for c in ('t1_mean', 'x1_mean'))} FROM ({_MT}) WINDOW w AS (PARTITION BY deviceId ORDER BY ym)", *(f"{c}_{k}" for c in ("t1_mean", "x1_mean") for k in ("lag1m", "lag2m", "mom1m"))))
def win_lag_month(s, d):
    m = T.monthly_features(V.mtel(s, d)).select("deviceId", "ym", "t1_mean", "x1_mean")
    return r6(enrich.month_lags(m, ["t1_mean", "x1_mean"]).drop("t1_mean", "x1_mean"))


@R.add("win_lag_raw", d6(V.with_views(f"SELECT event_id, {', '.join(f'lag(t1,{k}) OVER w AS t1_lag{k}' for k in (1, 12, 288))}, t1 - lag(t1,1) OVER w AS t1_mom1, t1 - lag(t1,288) OVER w AS t1_mom288 FROM tel WINDOW w AS (PARTITION BY deviceId ORDER BY timedate, event_id)", "tel"), "t1_lag1", "t1_lag12", "t1_lag288", "t1_mom1", "t1_mom288"))
def win_lag_raw(s, d):
    return r6(enrich.raw_lags(V.tel(s, d).select("event_id", "deviceId", "timedate", "t1"), ["t1"], ties=["event_id"]).drop("deviceId", "timedate", "t1"))


# forecasting, on months as the labelled rows

_LAB = "l AS (SELECT deviceId, CAST(year(timedate) AS INT) AS year, CAST(month(timedate) AS INT) AS month, CAST(year(timedate)*100+month(timedate) AS INT) AS ym, t1, t5, x2 AS target_x2 FROM mtel)"


def _lab(s, d):
    m = V.mtel(s, d)
    year, month = F.year("timedate"), F.month("timedate")
    return m.select("deviceId", year.alias("year"), month.alias("month"), dates.year_month(year, month).alias("ym"), "t1", "t5", F.col("x2").alias("target_x2"))


def _fc(name: str, sql: str, doubles: list[str], make):
    text = V.with_views(f"WITH {_LAB} {sql}", "mtel")
    R.add(name, d6(text, *doubles) if doubles else text)(lambda s, d: r6(make(_lab(s, d))))


FIRST = 200001
_fc("flt_labelled", "SELECT deviceId, ym, count(*) AS n FROM l WHERE target_x2 IS NOT NULL GROUP BY ALL", [], lambda x: forecast.labelled(x).groupBy("deviceId", "ym").agg(F.count("*").alias("n")))
_fc("flt_forecast", "SELECT deviceId, ym, count(*) AS n FROM l WHERE target_x2 IS NULL GROUP BY ALL", [], lambda x: forecast.forecast_rows(x).groupBy("deviceId", "ym").agg(F.count("*").alias("n")))
_fc("fc_folds", f"SELECT DISTINCT ym AS valid_ym FROM l WHERE target_x2 IS NOT NULL AND ym >= {FIRST}", [], lambda x: forecast.folds(x, FIRST))
_FOLD = f"f AS (SELECT DISTINCT ym AS valid_ym FROM l WHERE target_x2 IS NOT NULL AND ym >= {FIRST}), j AS (SELECT l.*, valid_ym, CASE WHEN ym = valid_ym THEN 'valid' ELSE 'train' END AS role FROM l JOIN f ON ym <= valid_ym WHERE target_x2 IS NOT NULL)"
_fc("join_fold", f", {_FOLD} SELECT valid_ym, role, count(*) AS n, sum(target_x2) AS total FROM j GROUP BY ALL", ["total"], lambda x: forecast.fold_rows(x, FIRST).groupBy("valid_ym", "role").agg(F.count("*").alias("n"), F.sum("target_x2").alias("total")))
_fc("flt_fold", f", {_FOLD} SELECT valid_ym, role, count(DISTINCT deviceId) AS devices FROM j GROUP BY ALL", [], lambda x: forecast.fold_rows(x, FIRST).groupBy("valid_ym", "role").agg(F.countDistinct("deviceId").alias("devices")))
_CV = f""", {_FOLD}, dm AS (SELECT valid_ym, deviceId, avg(target_x2) AS m FROM j WHERE role = 'train' GROUP BY ALL), gm AS (SELECT valid_ym, avg(target_x2) AS g, count(*) AS t FROM j WHERE role = 'train' GROUP BY ALL),
 v AS (SELECT j.valid_ym, j.deviceId, year, month, target_x2, coalesce(m, g) AS b, t FROM j LEFT JOIN dm ON j.valid_ym = dm.valid_ym AND j.deviceId = dm.deviceId JOIN gm ON gm.valid_ym = j.valid_ym WHERE role = 'valid'),
 a AS (SELECT valid_ym, deviceId, avg(target_x2) AS y, avg(b) AS p, count(*) AS n, sum(abs(target_x2 - b)) AS e, max(t) AS t FROM v GROUP BY ALL)
 SELECT valid_ym, max(t) AS train_rows, CAST(sum(n) AS BIGINT) AS valid_rows, count(*) AS monthly_rows, avg(abs(y-p)) AS baseline_monthly_mae, sum(e)/sum(n) AS baseline_row_mae FROM a GROUP BY ALL"""
_fc("fc_cv", _CV, ["baseline_monthly_mae", "baseline_row_mae"], lambda x: forecast.baseline_cv(x, FIRST))
_fc("agg_mae", _CV.rpartition("SELECT")[0] + "SELECT avg(abs(y-p)) AS monthly, sum(e)/sum(n) AS by_row FROM a", ["monthly", "by_row"], lambda x: forecast.baseline_cv(x, FIRST).agg((F.sum(F.col("baseline_monthly_mae") * F.col("monthly_rows")) / F.sum("monthly_rows")).alias("monthly"), (F.sum(F.col("baseline_row_mae") * F.col("valid_rows")) / F.sum("valid_rows")).alias("by_row")))
_fc("agg_dev_mean", "SELECT deviceId, avg(target_x2) AS device_mean FROM l WHERE target_x2 IS NOT NULL GROUP BY 1", ["device_mean"], lambda x: forecast.device_baseline(forecast.labelled(x))[0])
_fc("agg_global_mean", "SELECT avg(target_x2) AS global_mean FROM l WHERE target_x2 IS NOT NULL", ["global_mean"], lambda x: forecast.device_baseline(forecast.labelled(x))[1])
_BASE = ", dm AS (SELECT deviceId, avg(target_x2) AS m FROM l WHERE target_x2 IS NOT NULL AND CAST(deviceId AS INT) % 7 <> 0 GROUP BY 1), gm AS (SELECT avg(target_x2) AS g FROM l WHERE target_x2 IS NOT NULL AND CAST(deviceId AS INT) % 7 <> 0)"


def _based(x):
    train = forecast.labelled(x).where(F.col("deviceId").cast("int") % 7 != 0)
    return forecast.with_baseline(forecast.labelled(x), *forecast.device_baseline(train))


_fc("join_baseline", _BASE + " SELECT l.deviceId, ym, coalesce(m, g) AS baseline, count(*) AS n FROM l LEFT JOIN dm USING (deviceId), gm WHERE target_x2 IS NOT NULL GROUP BY ALL", ["baseline"], lambda x: _based(x).groupBy("deviceId", "ym", "baseline").agg(F.count("*").alias("n")))
_fc("fc_residual", _BASE + " SELECT l.deviceId, ym, sum(target_x2 - coalesce(m, g)) AS residual FROM l LEFT JOIN dm USING (deviceId), gm WHERE target_x2 IS NOT NULL GROUP BY ALL", ["residual"], lambda x: _based(x).groupBy("deviceId", "ym").agg(F.sum(F.col("target_x2") - F.col("baseline")).alias("residual")))
_fc("agg_pred_month", "SELECT deviceId, year, month, avg(target_x2) AS target_x2, avg(t1) AS t1 FROM l GROUP BY ALL", ["target_x2", "t1"], lambda x: forecast.month_means(x, ["target_x2", "t1"]))
_fc("win_group_size", "SELECT deviceId, ym, t5, target_x2, 1.0::DOUBLE/count(*) OVER (PARTITION BY deviceId, year, month) AS w FROM l", ["w", "t5", "target_x2"], lambda x: x.select("deviceId", "ym", "t5", "target_x2", forecast.group_weight().alias("w")))
_REC = "(SELECT min(ym) AS a, max(ym) AS b FROM l) e"
_fc("win_recency", f"SELECT deviceId, ym, t5, 0.8 + 0.4*(ym-a)/CASE WHEN b-a < 1 THEN 1 ELSE b-a END AS recency FROM l, {_REC}", ["recency", "t5"], lambda x: forecast.recency(x).select("deviceId", "ym", "t5", "recency"))
_fc("agg_quantile", "SELECT quantile_cont(t5, 0.1) AS q10, quantile_cont(t5, 0.9) AS q90 FROM l", ["q10", "q90"], lambda x: x.sparkSession.createDataFrame([tuple(stats.quantiles(x, "t5", (0.1, 0.9)))], "q10 double, q90 double"))
_WT = f"""SELECT deviceId, ym, t5, target_x2, CASE WHEN p < 1e-4 THEN 1e-4 WHEN p > 10 THEN 10 ELSE p END AS weight FROM (SELECT l.*, (0.8 + 0.4*(ym-a)/CASE WHEN b-a < 1 THEN 1 ELSE b-a END)
 * (0.7 + 0.6*CASE WHEN (t5-c)/(d-c) < 0 THEN 0 WHEN (t5-c)/(d-c) > 1 THEN 1 ELSE (t5-c)/(d-c) END) / count(*) OVER (PARTITION BY deviceId, year, month) AS p FROM l, {_REC}, (SELECT quantile_cont(t5,0.1) AS c, quantile_cont(t5,0.9) AS d FROM l) q)"""
_fc("win_weights", _WT, ["t5", "target_x2", "weight"], lambda x: forecast.weighted(x, " Device_month_equal+recent+warm", "t5").select("deviceId", "ym", "t5", "target_x2", "weight"))
_GRID = "g AS (SELECT CAST(i AS DOUBLE)*0.05::DOUBLE AS w FROM range(21) t(i)), b AS (SELECT w, avg(abs(target_x2 - CASE WHEN w*t1 + (1-w)*t5 < 0 THEN 0 ELSE w*t1 + (1-w)*t5 END)) AS mae FROM l, g WHERE target_x2 IS NOT NULL GROUP BY w)"
_fc("fc_blend_grid", f", {_GRID} SELECT w, mae FROM b", ["w", "mae"], lambda x: forecast.blend_grid(forecast.labelled(x), "target_x2", "t1", "t5"))
_fc("fc_blend", f", {_GRID} SELECT w, mae FROM b ORDER BY round(mae, 12), abs(w-1) > 1e-9, w LIMIT 1", ["w", "mae"], lambda x: forecast.best_blend(forecast.blend_grid(forecast.labelled(x), "target_x2", "t1", "t5")))
_MONTHS = [(2001, m) for m in range(1, 12)]
_VAL = "(VALUES " + ", ".join(f"({y},{m})" for y, m in _MONTHS) + ") v(year, month)"
_fc("join_grid", f"SELECT deviceId, CAST(year AS INT) AS year, CAST(month AS INT) AS month FROM (SELECT DISTINCT deviceId FROM l), {_VAL}", [], lambda x: forecast.forecast_grid(x, _MONTHS))
_DENSE = f""", p AS (SELECT deviceId, year, month, avg(t1) AS p FROM l WHERE target_x2 IS NULL AND CAST(deviceId AS INT) % 3 <> 0 GROUP BY ALL), dm AS (SELECT deviceId, avg(target_x2) AS m FROM l WHERE target_x2 IS NOT NULL AND CAST(deviceId AS INT) % 6 <> 0 GROUP BY 1),
 gm AS (SELECT avg(target_x2) AS g FROM l WHERE target_x2 IS NOT NULL), z AS (SELECT g0.deviceId, CAST(g0.year AS INT) AS year, CAST(g0.month AS INT) AS month, greatest(coalesce(p, m, g), 0) AS prediction FROM (SELECT deviceId, year, month FROM (SELECT DISTINCT deviceId FROM l), {_VAL}) g0
 LEFT JOIN p ON p.deviceId = g0.deviceId AND p.year = g0.year AND p.month = g0.month LEFT JOIN dm ON dm.deviceId = g0.deviceId, gm)"""


def _dense(x):
    predictions = forecast.month_means(forecast.forecast_rows(x).where(F.col("deviceId").cast("int") % 3 != 0).withColumn("prediction", F.col("t1")), ["prediction"])
    lab = forecast.labelled(x)
    means = lab.where(F.col("deviceId").cast("int") % 6 != 0).groupBy("deviceId").agg(F.avg("target_x2").alias("device_mean"))
    return forecast.densified(forecast.forecast_grid(x, _MONTHS), predictions, means, lab.agg(F.avg("target_x2").alias("global_mean")))


_fc("join_densify", _DENSE + " SELECT * FROM z", ["prediction"], _dense)
_fc("fc_check", _DENSE + " SELECT count(*) AS n_rows, count(DISTINCT deviceId) AS devices, count(*) FILTER (prediction IS NULL) AS missing, count(DISTINCT year*100+month) AS months, count(*) = count(DISTINCT deviceId)*11 AND count(*) FILTER (prediction IS NULL) = 0 AND count(DISTINCT year*100+month) = 11 AS ok FROM z", [], lambda x: forecast.submission_check(_dense(x), 11))
_fc("fc_metric", "SELECT avg(target_x2)*2/6 + avg(t1)*4/6 AS score FROM l", ["score"], lambda x: x.agg(forecast.final_metric(F.avg("target_x2"), F.avg("t1")).alias("score")))
_fc("agg_corr_topn", "SELECT * FROM (SELECT 't1' AS feature, corr(t1, target_x2) AS corr FROM l WHERE target_x2 IS NOT NULL UNION ALL SELECT 't5', corr(t5, target_x2) FROM l WHERE target_x2 IS NOT NULL UNION ALL SELECT 'month', corr(month, target_x2) FROM l WHERE target_x2 IS NOT NULL UNION ALL SELECT 'ym', corr(ym, target_x2) FROM l WHERE target_x2 IS NOT NULL) ORDER BY abs(corr) DESC, feature LIMIT 3", ["corr"], lambda x: stats.correlations(x, ["t1", "t5", "month", "ym"], "target_x2", 3))
_fc("flt_std_pos", "SELECT * FROM (SELECT 't1' AS feature, stddev_samp(t1) AS std FROM l UNION ALL SELECT 't5', stddev_samp(t5) FROM l UNION ALL SELECT 'flat', 0.0)  WHERE std > 0", ["std"], lambda x: stats.varying(x.withColumn("flat", F.lit(1.0)), ["t1", "t5", "flat"]))
_CVW = _CV.rpartition("SELECT")[0] + "SELECT valid_ym, avg(abs(y-p)) AS mae, count(*) AS n FROM a GROUP BY 1"
_fc("agg_wavg", f"{_CV.rpartition('SELECT')[0]}, c AS (SELECT valid_ym, avg(abs(y-p)) AS mae, count(*) AS n FROM a GROUP BY 1) SELECT sum(mae*n)/sum(n) AS wavg FROM c".replace(", c AS", ", c AS", 1), ["wavg"], lambda x: forecast.baseline_cv(x, FIRST).agg(stats.weighted_average(F.col("baseline_monthly_mae"), F.col("monthly_rows")).alias("wavg")))
_fc("agg_median", f"{_CV.rpartition('SELECT')[0]}, c AS (SELECT valid_ym, count(*) AS n FROM a GROUP BY 1) SELECT CAST(round_even(median(n)*1.1::DOUBLE, 0) AS BIGINT) AS iterations FROM c", [], lambda x: forecast.baseline_cv(x, FIRST).agg(F.bround(F.percentile("monthly_rows", F.lit(0.5)) * 1.1).cast("long").alias("iterations")))
_fc("agg_best", f"{_CV.rpartition('SELECT')[0]}, c AS (SELECT valid_ym, avg(abs(y-p)) AS mae FROM a GROUP BY 1) SELECT bool_and(mae < 0.3) AS all_better, min(mae) AS low, max(mae) AS high, avg(mae) AS mean FROM c", ["low", "high", "mean"], lambda x: forecast.baseline_cv(x, FIRST).agg(F.bool_and(F.col("baseline_monthly_mae") < 0.3).alias("all_better"), F.min("baseline_monthly_mae").alias("low"), F.max("baseline_monthly_mae").alias("high"), F.avg("baseline_monthly_mae").alias("mean")))


@R.add("fc_model")
def fc_model(s, d):
    x = _lab(s, d)
    train = forecast.labelled(x).where(f"ym < {FIRST}")
    rows = forecast.labelled(x).where(f"ym >= {FIRST}")
    return r6(forecast.month_means(forecast.gbt_residual_predictions(train, rows, ["t1", "t5", "month"]), ["target_x2", "prediction"]))


@R.add("fc_final")
def fc_final(s, d):
    x = _lab(s, d)
    train, ahead = forecast.labelled(x), forecast.forecast_rows(x)
    predictions = forecast.month_means(forecast.gbt_residual_predictions(train, ahead, ["t1", "t5", "month"]), ["prediction"])
    means, overall = forecast.device_baseline(train)
    return r6(forecast.densified(forecast.forecast_grid(x, _MONTHS), predictions, means, overall))


# sorts, samples, sets

_fc("sort_multi", "SELECT deviceId, year, month, avg(t1) AS t1 FROM l GROUP BY ALL ORDER BY ALL", ["t1"], lambda x: forecast.month_means(x, ["t1"]).orderBy("deviceId", "year", "month"))
_fc("set_union", "SELECT deviceId, ym FROM l WHERE ym < 199601 UNION ALL SELECT deviceId, ym FROM l WHERE ym > 200106", [], lambda x: x.where("ym < 199601").select("deviceId", "ym").unionByName(x.where("ym > 200106").select("ym", "deviceId")))
_fc("set_distinct", "SELECT DISTINCT deviceId, year FROM l", [], lambda x: x.select("deviceId", "year").distinct())
_fc("set_hconcat", "SELECT deviceId, ym, avg(t1) AS a, avg(t5) AS b FROM l GROUP BY ALL", ["a", "b"], lambda x: x.groupBy("deviceId", "ym").agg(F.avg("t1").alias("a")).join(x.groupBy("deviceId", "ym").agg(F.avg("t5").alias("b")), ["deviceId", "ym"]))


@R.add("smp_stratified")
def smp_stratified(s, d):
    m = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", dates.year_month(F.year("l_shipdate"), F.month("l_shipdate")).alias("ym"))
    return stats.stratified_sample(m, "ym", 0.25, ["l_orderkey", "l_linenumber"])


@R.add("smp_split")
def smp_split(s, d):
    return stats.hash_split(V.table(s, d, "orders").select("o_orderkey"), ["o_orderkey"])


@R.add("flt_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 7, 32) ORDER BY o_orderkey")
def flt_ids(s, d):
    return V.table(s, d, "orders").where(F.col("o_orderkey").isin(1, 5, 7, 32)).select("o_orderkey", "o_totalprice")


@R.add("flt_offset_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def flt_offset_limit(s, d):
    return V.table(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(20)


@R.add("topk_early_stop")
def topk_early_stop(s, d):
    return V.tel(s, d).select("event_id", "t1").limit(100)


@R.add("entry_profile", d6(V.with_views(f"WITH f AS ({_F6}) SELECT deviceId, date, n_rows, active_ratio, t1_mean, t1_std, weekday, lag(t1_mean,1) OVER w AS t1_lag1, avg(t1_mean) {_past(3)} AS t1_roll3 FROM f WINDOW w AS (PARTITION BY deviceId ORDER BY date)", "tel"), "active_ratio", "t1_mean", "t1_std", "t1_lag1", "t1_roll3"))
def entry_profile(s, d):
    """Daily device profile with recent history."""
    f = T.time_features(V.tel(s, d), "D", ["t1", "x1"])
    w = Window.partitionBy("deviceId").orderBy("date")
    return r6(f.select("deviceId", "date", "n_rows", "active_ratio", "t1_mean", "t1_std", "weekday", F.lag("t1_mean", 1).over(w).alias("t1_lag1"), F.avg("t1_mean").over(w.rowsBetween(-3, -1)).alias("t1_roll3")))
