"""Missing values, merging of states, intervals, hierarchies and scores on small hand-written frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates, nulls
from siltstone.operators import context, enrich, forecast, hierarchy, signal, stats, text
from siltstone.operators import telemetry as T
from siltstone.plans import views


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


@pytest.fixture(scope="module")
def tel(spark):
    rows = [("a", day(0, 1), "train", 1, 0, 0.2, None, 1.0, 0.5), ("a", day(0, 2), "train", 1, 0, 0.6, None, 0.0, None), ("a", day(3, 1), "train", 1, 0, None, None, None, None), (None, day(0), "train", 1, 0, 0.1, 0.2, 1.0, 1.0), ("b", None, "train", 1, 0, 0.1, 0.2, 1.0, 1.0)]
    return spark.createDataFrame(rows, "deviceId string, timedate timestamp_ntz, period string, deviceType int, x3 int, t1 double, t2 double, x1 double, x2 double")


def test_missing_values_of_a_bucket(tel):
    r = {x["date"]: x for x in T.time_features(tel, "D", ["t1", "t2", "x1"]).collect()}
    assert set(r) == {day(0), day(3)}  # no row without a device or a time
    first, last = r[day(0)], r[day(3)]
    assert first["t2_mean"] == 0.0 and first["t2_min"] is None  # a sum of nothing is 0, an extreme of nothing is missing
    assert first["t1_mean"] == pytest.approx(0.4) and first["target_x2"] == 0.5 and first["active_ratio"] == 0.5
    assert last["t1_mean"] == 0.0 and last["target_x2"] is None and last["active_ratio"] == 0.0


def test_lags_count_rows_not_days(tel):
    f = T.time_features(tel, "D", ["t1"]).select("deviceId", "date", "t1_mean")
    r = f.select("*", *enrich.lagged(["t1_mean"], [1])).orderBy("date").collect()
    assert [x["t1_mean_lag1"] for x in r] == [None, pytest.approx(0.4)]


def test_states_of_parts_merge_to_the_whole(spark, sf):
    t = views.tel(spark, sf)
    whole = T.time_features(t, "D", ["t1", "t2"])
    hours = T.bucket_partials(t, "1h", ["t1", "t2"]).withColumn("date", F.date_trunc("day", "date").cast("timestamp_ntz"))
    rolled = T.finish_buckets(T.merge_partials(hours))
    names = [c for c in whole.columns if c not in ("period",)]
    near = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.select(*names).select("deviceId", "date", "n_rows", "t1_mean", "t2_std", "t1_max").collect())
    assert near(whole) == near(rolled)


def test_clip_keeps_missing(spark):
    r = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x double").select(nulls.clip(F.col("x"), 0.0, 2.0).alias("y")).collect()
    assert [x["y"] for x in r] == [None, 0.0, 2.0]


def test_nan_is_missing(spark):
    r = nulls.without_nan(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")).orderBy("s").collect()
    assert [x["x"] for x in r] == [None, 1.0]


def test_frequencies():
    assert [dates.freq_seconds(f) for f in ("D", "12H", "30min")] == [86400, 43200, 1800]
    for bad in ("", "0h", "week", None):
        with pytest.raises(ValueError):
            dates.freq_seconds(bad)


def test_bad_times_are_missing(spark):
    r = spark.createDataFrame([("2024-02-29 10:00:00",), ("2024-02-30",), ("x",), (None,)], "s string").select(dates.parse_time(F.col("s")).alias("t")).collect()
    assert [x["t"] for x in r] == [dt.datetime(2024, 2, 29, 10), None, None, None]


def test_baseline_falls_back_to_all_rows(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "deviceId string, target_x2 double")
    rows = spark.createDataFrame([("a",), ("new",)], "deviceId string")
    r = {x["deviceId"]: x["baseline"] for x in forecast.with_baseline(rows, *forecast.device_baseline(train)).collect()}
    assert r == {"a": 2.0, "new": 4.0}


def test_blend_ties_keep_the_first_model(spark):
    d = spark.createDataFrame([(1.0, 1.0, 1.0)], "y double, a double, b double")
    assert forecast.best_blend(forecast.blend_grid(d, "y", "a", "b")).first()["w"] == 1.0


def test_sample_size_is_half_even(spark):
    d = spark.range(30).select("id", F.when(F.col("id") < 10, 1).otherwise(2).alias("ym"))
    n = {x["ym"]: x["count"] for x in stats.stratified_sample(d, "ym", 0.25, ["id"]).groupBy("ym").count().collect()}
    assert n == {1: 2, 2: 5}
    with pytest.raises(ValueError):
        stats.stratified_sample(d, "ym", 0, ["id"])


def brute_merge(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_equals_the_sequential_one(spark):
    rng = random.Random(3)
    rows = [("p", s := rng.randrange(300), s + rng.randrange(12), s, i) for i in range(60)]
    d = spark.createDataFrame(rows, "path string, start long, end long, anchor long, selection long")
    got = sorted((r["start"], r["end"]) for r in context.merged(d).collect())
    assert got == brute_merge([(r[1], r[2]) for r in rows])
    assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_touching_intervals_stay_apart(spark):
    d = spark.createDataFrame([("p", 1, 5, 1, 0), ("p", 6, 9, 6, 1)], "path string, start long, end long, anchor long, selection long")
    assert context.merged(d).count() == 2


def test_greedy_fit_skips_what_is_too_large(spark):
    fit = lambda sizes: spark.range(1).select(context.greedy_fit(F.array(*(F.struct(F.lit(i).cast("long").alias("k"), F.lit(s).cast("long").alias("size")) for i, s in enumerate(sizes))), 10).alias("k")).first()["k"]
    assert fit([6, 7, 4]) == [0, 2] and fit([20, 1]) == [0] and fit([3, 20, 3]) == [0, 2]


DAG = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]


def test_depth_and_closure_of_a_diamond(spark):
    e = spark.createDataFrame(DAG, "child string, parent string")
    assert {r["class"]: r["depth"] for r in hierarchy.depths(e).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_repair_is_idempotent_and_without_violations(spark):
    e = spark.createDataFrame(DAG, "child string, parent string")
    rng = random.Random(5)
    labels = spark.createDataFrame([(i, c, rng.randrange(2)) for i in range(20) for c in "abcde"], "row_id int, class string, p int")
    once = hierarchy.repaired(labels, e)
    assert hierarchy.violations(once, e).first()["violations"] == 0
    as_set = lambda d: {tuple(r) for r in d.select("row_id", "class", "p").collect()}
    assert as_set(once) == as_set(hierarchy.repaired(once, e))


def test_tie_break_is_sequential(spark):
    e = spark.createDataFrame([(0, "b", "a"), (1, "d", "b")], "n int, child string, parent string")
    v = spark.createDataFrame([(1, "a", 0.2, 0), (1, "b", 0.6, 1), (1, "d", 0.1, 0), (2, "a", 0.4, 0), (2, "b", 0.3, 1), (2, "d", 0.9, 1)], "row_id int, class string, p double, label int")
    got = {(r["row_id"], r["class"]): r["label"] for r in hierarchy.tie_broken(v, e).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (1, "d"): 0, (2, "a"): 0, (2, "b"): 1, (2, "d"): 1}


def test_chrf_of_equal_and_empty_texts(spark):
    d = spark.createDataFrame([(1, "abcabc", "abcabc"), (2, "", ""), (3, "a", ""), (4, "abc", "xyz")], "id int, a string, b string")
    got = {r["id"]: r["chrf"] for r in text.chrf(d, ["id"], "a", "b").collect()}
    assert got == {1: pytest.approx(1.0), 2: 1.0, 3: 0.0, 4: 0.0}


def test_recovery_between_prefix_and_suffix(spark):
    d = spark.createDataFrame([("abcXYZdef", "abc", "def"), ("abcXYZ", "abc", ""), ("abc", "q", ""), ("abcX", "abc", "z")], "t string, p string, s string")
    assert [r[0] for r in d.select(text.between(F.col("t"), F.col("p"), F.col("s"))).collect()] == ["XYZ", "XYZ", None, None]


def test_blocks_with_and_without_separator(spark):
    d = spark.createDataFrame([(1, "plain"), (2, "<|file_sep|>a.py\nx\n<|file_sep|>\n\nb.py\ny"), (3, "")], "id int, context string")
    got = [(r["id"], r["path"], r["content"]) for r in text.blocks(d, ["id"]).orderBy("id", "k").collect()]
    assert got == [(1, "", "plain"), (2, "a.py", "x\n"), (2, "b.py", "y")]


def test_peaks_keep_their_distance(spark):
    v = [0.0] * 40
    for i, h in ((3, 5.0), (5, 4.0), (20, 3.0), (30, 2.0), (38, 1.0)):
        v[i] = h
    d = spark.createDataFrame([(1, v)], "vec_id int, v array<double>")
    assert d.select(signal.peaks(F.col("v"), 4, 8).alias("p")).first()["p"] == [3, 20, 30, 38]


def test_resampling_keeps_the_ends(spark):
    d = spark.createDataFrame([(1, [0.0, 1.0, 4.0])], "vec_id int, v array<double>")
    assert d.select(signal.resampled(F.col("v"), 5).alias("p")).first()["p"] == [0.0, 0.5, 1.0, 2.5, 4.0]


def test_enrichment_has_one_window_exchange(spark, sf):
    f = T.time_features(views.tel(spark, sf), "D", ["t1", "x1"])
    plan = enrich.enriched(f, None, ["t1_mean"], ["t1_mean"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_unknown_json_keys_are_an_error(spark, tmp_path):
    from siltstone.sources import readers, schemas

    (tmp_path / "x.json").write_text('{"context": "a"}\n\n{"context": "b"}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.json"), schemas.PREDICTIONS).count() == 2
    (tmp_path / "y.json").write_text('{"context": "a", "other": 1}\n')
    with pytest.raises(Exception, match="unknown keys"):
        readers.json_lines(spark, str(tmp_path / "y.json"), schemas.PREDICTIONS).collect()


def test_quantiles_by_bins_are_exact(spark, monkeypatch):
    import numpy as np

    rng = random.Random(8)
    x = [rng.choice([rng.gauss(0, 1), 5.0, 1e6]) for _ in range(3000)]
    d = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
    monkeypatch.setattr(stats, "DIRECT_VALUES", 50)
    got = stats.quantiles(d, "v", (0.0, 0.1, 0.5, 0.77, 1.0))
    assert got == pytest.approx(np.quantile(x, (0.0, 0.1, 0.5, 0.77, 1.0)).tolist())
    assert stats.quantiles(d.where("false"), "v", (0.5,)) == [None]


def test_context_buffer_keeps_its_budget():
    b = context.ContextBuffer(budget=400, most=3)
    for i in range(5):
        assert b.add(f"p{i}", 1, "\n".join(f"line {k}" for k in range(60)), 30)
    assert len(b.preview()) <= 400 and len(b.snippets) == 3 and all(len(s[2]) >= 12 for s in b.snippets)
    assert not b.add("big", 1, "x" * 1000)
    b.reset()
    assert b.preview() == ""


def test_content_containment(spark):
    import random

    from siltstone.operators import context

    def brute(blocks):
        kept = []
        for b in blocks:
            for i, k in enumerate(kept):
                if b[1] and b[1] in k[1]:
                    break
                if k[1] and k[1] in b[1]:
                    kept[i] = b
                    break
            else:
                kept.append(b)
        return kept

    rng = random.Random(3)
    groups = [[(i, "".join(rng.choice("ab") for _ in range(rng.randrange(6)))) for i in range(rng.randrange(9))] for _ in range(60)]
    df = spark.createDataFrame([(g, b) for g, b in enumerate(groups)], "g int, b array<struct<k:int,content:string>>")
    got = {r["g"]: [(x["k"], x["content"]) for x in r["kept"]] for r in df.select("g", context.without_contained(F.col("b")).alias("kept")).collect()}
    assert got == {g: brute(b) for g, b in enumerate(groups)}


def test_weights_of_missing_warmth_and_names(spark):
    from siltstone.operators import forecast

    rows = [("1", 2024, 10, 202410, 1.0), ("1", 2024, 10, 202410, None), ("2", 2024, 12, 202412, 3.0)]
    df = spark.createDataFrame(rows, "deviceId string, year int, month int, ym int, t1 double")
    weight = lambda mode: [r["weight"] for r in forecast.weighted(df, mode, "t1").orderBy("deviceId", F.col("t1").isNull()).collect()]
    assert weight("none") == [1.0] * 3 and weight("device_month_equal") == [0.5, 0.5, 1.0]
    assert weight(" Recent") == pytest.approx([0.8, 0.8, 1.2]) and weight("warm")[1] is None and weight("warm")[0] == pytest.approx(0.7)


def test_reordered_blocks(spark):
    """Against a plain version: redundant blocks of a path go, the strongest come first, and what fits is taken."""
    import random

    from siltstone.operators import context

    target, changed = "a/b/main.py", {"a/c/x.py"}
    paths = [target, "a/c/x.py", "a/b/near.py", "tests/test_far.py", "a/b/README.md", "docs/notes.txt"]
    worth = {target: 1220.0, "a/c/x.py": 350.0, "a/b/near.py": 220.0, "tests/test_far.py": -220.0, "a/b/README.md": 220.0 - 320.0, "docs/notes.txt": 0.0}

    def plain(blocks, budget, most):
        kept = []
        for b in blocks:
            hit = next((i for i, x in enumerate(kept) if x[1] == b[1] and (b[2] and b[2] in x[2] or x[2] and x[2] in b[2])), None)
            if hit is None:
                kept.append(b)
            elif not (b[2] and b[2] in kept[hit][2]):
                kept[hit] = b
        lines = lambda c: len(c.split("\n")) if c else 0
        kept = sorted(kept, key=lambda b: (-round(worth[b[1]] + 0.4 * min(220, lines(b[2])), 9), b[0]))[:most]
        out, used = [], 0
        for b in kept:
            size = len("<|file_sep|>") + len(b[1]) + 1 + len(b[2])
            if not out and size > budget:
                return [b]
            if used + size + bool(out) <= budget:
                used += size + bool(out)
                out.append(b)
        return out

    rng = random.Random(9)
    groups = [[(i, rng.choice(paths), "\n".join(rng.choice(("x", "y", "")) for _ in range(rng.randrange(6)))) for i in range(rng.randrange(1, 10))] for _ in range(60)]
    found = spark.createDataFrame([(g, *b) for g, bs in enumerate(groups) for b in bs], "g int, k int, path string, content string")
    for budget, most in ((70, 4), (30, 10), (10_000, 10)):
        got = {}
        for r in context.reordered(found, ["g"], F.lit(target), F.col("path").isin(*changed), budget, most).orderBy("g", "place").collect():
            got.setdefault(r["g"], []).append((r["k"], r["path"], r["content"]))
        assert got == {g: plain(bs, budget, most) for g, bs in enumerate(groups)}


def test_first_reference_takes_the_target_before_the_changed_files(spark):
    from siltstone.operators import text

    rows = [("r", 0, "t.py", "no prefix"), ("r", 2, "c.py", "A late B"), ("r", 1, "b.py", "A\r\nearly B"), ("s", 0, "t.py", "A  B"), ("s", 1, "b.py", "A x B"), ("u", 0, "t.py", None)]
    df = spark.createDataFrame(rows, "rec string, rank int, path string, text string")
    got = {r["rec"]: (r["path"], r["ref"]) for r in text.first_reference(df, ["rec"], "rank", F.lit("A"), F.lit("B")).collect()}
    assert got == {"r": ("b.py", "\nearly "), "s": ("t.py", "  ")}


def test_final_pack_prunes_shrinks_and_drops(spark):
    from siltstone.operators import context

    def snippet(record, selection, path, n, base, width=9, own=False, small=False, anchor=None):
        return (record, selection, path, 1, "\n".join(f"{i:0{width}d}" for i in range(1, n + 1)), anchor, base, own, small)

    rows = [
        # three supports beside the target: two stay, of the equal ones the later
        snippet("prune", 0, "a", 5, 10.0), snippet("prune", 1, "b", 5, 10.0), snippet("prune", 2, "c", 5, 50.0), snippet("prune", 3, "t", 5, 1000.0, own=True),
        # a small target that isn't chosen leaves room for three
        snippet("alone", 0, "a", 5, 10.0, small=True), snippet("alone", 1, "b", 5, 10.0, small=True), snippet("alone", 2, "c", 5, 50.0, small=True), snippet("alone", 3, "d", 5, 1.0, small=True),
        # 7,000 and two times 2,000 characters: the weaker support shrinks to 56 lines around its anchor, which is enough
        snippet("shrink", 0, "t", 700, 1000.0, own=True), snippet("shrink", 1, "a", 200, 5.0, anchor=190), snippet("shrink", 2, "b", 200, 9.0),
        # no support fits beside a target of 12,000
        snippet("drop", 0, "t", 1200, 1000.0, own=True), snippet("drop", 1, "a", 200, 5.0),
        ("null", 0, "x", 1, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record string, selection int, path string, start int, content string, anchor int, base double, own boolean, small boolean")
    got = {}
    for r in context.final_pack(df, "record").orderBy("record", "place").collect():
        got.setdefault(r["record"], []).append((r["path"], r["start"], len(r["content"].split("\n"))))
    assert got == {
        "prune": [("t", 1, 5), ("c", 1, 5), ("b", 1, 5)],
        "alone": [("c", 1, 5), ("a", 1, 5), ("b", 1, 5)],
        "shrink": [("t", 1, 700), ("b", 1, 200), ("a", 145, 56)],
        "drop": [("t", 1, 1200)],
        "null": [("x", 1, 1)],
    }


def test_the_result_of_a_stream_does_not_pass_the_driver(spark, tmp_path):
    from siltstone.plans.common import r6
    from siltstone.plans.signal_queries import stream_buckets
    from siltstone.streaming.buckets import STATES

    # 20,000 buckets of two rows: about 2 MB, were they collected
    spark.range(40000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id % 2 AS INT)) AS ts", "id div 2 AS user_id", "'click' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    before, conf = {k: spark.conf.get(k, None) for k in STATES}, spark.sparkContext._jsc.sc().conf()
    limit = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        got = stream_buckets(spark, str(tmp_path))
        want = r6(T.time_features(views.tel(spark, str(tmp_path)), "6h", ["t1"]).select(*got.columns))
        assert got.count() == 20000 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    finally:
        conf.set("spark.driver.maxResultSize", limit)
    assert {k: spark.conf.get(k, None) for k in STATES} == before  # the session's settings are as they were
