"""Exact quantiles of large keys, steps of long spans, sweeps of scores, co-moments, folds in the plan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleanse as C
from tidewatch.operators import evaluate as E
from tidewatch.operators import features as X
from tidewatch.operators import quality as Q
from tidewatch.operators import splits as P
from tidewatch.operators import windows as W
from tidewatch.operators.chunks import with_steps
from tidewatch.operators.quantiles import exact_quantiles

AT = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q77": 0.77, "q100": 1.0}


def quantile(values, q):
    v, place = sorted(values), (len(values) - 1) * q
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if math.floor(place) == math.ceil(place) else a + (b - a) * (place - math.floor(place))


def test_quantiles_by_selection(spark):
    """Bins of 16 and at most 50 values at once: many levels, for values that lie close, far apart, tied or without end."""
    rng = np.random.default_rng(1)
    rows = [("normal", float(x)) for x in rng.normal(0, 1, 5000)] + [("ties", float(x)) for x in rng.integers(0, 3, 3000)] + [("one", 3.5)] + [("none", None)] * 3
    rows += [("wide", float(x)) for x in rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-300, 300, 2000)] + [(None, float(i)) for i in range(700)]
    rows += [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)] + [("inf", float(x)) for x in [*range(500), *[math.inf] * 300, *[-math.inf] * 30]]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", AT, bins=16, most=50).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        v = [x for a, x in rows if a == k and x is not None and not math.isnan(x)]
        assert r["n"] == len(v)
        for name, q in AT.items():
            assert r[name] is None if not v else r[name] == quantile(v, q) or math.isnan(quantile(v, q)), (k, name)


def test_quantiles_of_small_keys_need_one_group_each(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", AT).collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in AT.items()]).collect()
    assert all(got[w["k"]][n] == pytest.approx(w[n], abs=1e-9) for w in want for n in AT)
    assert exact_quantiles(df.limit(0), ["k"], "v", AT).count() == 0


def test_iqr_median_and_boxes_of_a_hot_key(spark, monkeypatch):
    from tidewatch.operators import quantiles

    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (8, 20))
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "a").otherwise("b").alias("label"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("value"), "id")
    p = {q: F.percentile("value", F.lit(q)) for q in (0.25, 0.5, 0.75)}
    want = {r[0]: r[1:] for r in df.groupBy("label").agg(F.min("value"), *p.values(), F.max("value")).collect()}
    assert {r[0]: tuple(r[1:]) for r in Q.box_stats(df, "value").collect()} == {k: tuple(v) for k, v in want.items()}
    high = {r["id"] for r in C.flag_iqr(df, ["label"], 0.3).filter("is_outlier").collect()}
    assert high == {r["id"] for r in df.collect() if r["value"] > want[r["label"]][3] + 0.3 * (want[r["label"]][3] - want[r["label"]][1])} and high


def test_steps_of_a_long_span(spark):
    spans = spark.createDataFrame([("a", 5, 5), ("b", -3, 200_000), ("c", 4, 3)], "k string, lo long, hi long")
    got = {r["k"]: r for r in with_steps(spans, "lo", "hi", "at", ["k"]).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    assert set(got) == {"a", "b"} and tuple(got["a"])[1:] == (1, 1, 5, 5) and tuple(got["b"])[1:] == (200_004, 200_004, -3, 200_000)
    # 10^11 steps plan at once and come lazily
    long = with_steps(spark.createDataFrame([(0, 10**11)], "lo long, hi long"), "lo", "hi", "at", [])
    assert long.limit(3).count() == 3


def test_a_stray_time_is_one_row(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.04, 2.0), (1, 1.7e9, 3.0), (None, 5.0, 4.0), (None, None, 9.0)], "k int, timestamp double, value double")
    got = C.regular_grid(df, ["k"], 0.02, longest=60).collect()
    assert sorted((r["k"] or 0, round(r["timestamp"], 2), r["value"]) for r in got if r["value"] is not None) == [(0, 5.0, 4.0), (1, 0.0, 1.0), (1, 0.04, 2.0), (1, 1.7e9, 3.0)]
    assert len(got) == 5 and set(got[0].asDict()) == {"k", "timestamp", "value"}
    assert [tuple(r) for r in C.grid_breaks(df, ["k"], 60).collect()] == [(1, 0.04, 1.7e9)]
    # without the limit the span plans too: rows come chunk by chunk
    assert C.regular_grid(df.filter("k = 1"), ["k"], 2000.0).filter("value is not null").count() == 3


def test_horizon_windows_of_a_long_session(spark):
    rows = spark.range(150_000).select(F.lit("s").alias("session_id"), F.col("id").cast("double").alias("timestamp"), (F.col("id") % 50_000 == 49_999).alias("flag"))
    got = W.horizon_label(rows, ["session_id"], ["timestamp"], F.col("flag"), 100, 20, 1)
    assert got.count() == 149_900 and got.filter("y = 1").count() == 60


def test_a_value_is_shuffled_twice_at_most_however_much_windows_overlap(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") / 20).alias("timestamp"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("value"))
    for size in (1, 3, 50):
        fast = {(r["k"], r["window_start"]): r for r in X.sliding_stats(df, ["k"], size, 1.0).collect()}
        plain = {(r["k"], r["window_start"]): r for r in X.window_stats(W.time_windows(df, float(size), 1.0), ["k", "window_start"]).collect()}
        assert set(fast) == set(plain)
        assert all(fast[w][c] == pytest.approx(plain[w][c], abs=1e-9) for w in plain for c in ("n", *X.STATISTICS))
    sent = lambda size: X.sliding_stats(df, ["k"], size, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert all(sent(size).count("Exchange hashpartitioning") <= 2 for size in (3, 50))
    blocks = df.withColumn("_b", F.floor("timestamp")).selectExpr("size(if(_b div 50 > 0 and _b % 50 < 49, array(0, 1), array(0))) as copies")
    assert blocks.agg(F.max("copies")).first()[0] == 2


def test_ranks_of_a_fold_are_swept_in_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(y), None if i % 97 == 0 else round(float(p), 2 if k else 6)) for k in (0, 1) for i, (y, p) in enumerate(zip(rng.integers(0, 2, 900), rng.random(900), strict=True))] + [(2, 1, 0.5), (2, 1, 0.5)]
    df = spark.createDataFrame(rows, "fold int, y int, p double").repartition(3)
    auc = {r["fold"]: r["auc"] for r in E.fold_auc(df).collect()}
    assert auc[2] is None
    for k in (0, 1):
        x = [(-1.0 if p is None else p, y) for f, y, p in rows if f == k]
        pos, neg = [p for p, y in x if y], [p for p, y in x if not y]
        assert auc[k] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
        roc = [tuple(r)[1:] for r in E.roc_curve(df.filter(f"fold = {k}").filter("p is not null")).orderBy(F.desc("threshold")).collect()]
        known = [(p, y) for p, y in x if p >= 0]
        n1, n0 = sum(y for _, y in known), sum(1 - y for _, y in known)
        want = [(t, sum(y for p, y in known if p >= t) / n1, sum(1 - y for p, y in known if p >= t) / n0) for t in sorted({p for p, _ in known}, reverse=True)]
        assert roc == [pytest.approx(w) for w in want]


def test_correlation_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 30)) @ rng.normal(size=(30, 30)) + 1e6
    x[:, 7] = 4.0
    cols = [f"c {i}" for i in range(30)]
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, *[1.0] * 29)], ", ".join(f"`{c}` double" for c in cols)).repartition(70)
    got = {(r["a"], r["b"]): r["r"] for r in Q.correlation(df, cols, fan=3, levels=2).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    assert len(got) == 30 * 31 // 2
    assert all((got[cols[i], cols[j]] is None) if 7 in (i, j) else abs(got[cols[i], cols[j]] - want[i, j]) < 0.006 for i in range(30) for j in range(i, 30))
    assert [r["r"] for r in Q.correlation(df.limit(0), cols[:2]).collect()] == [None] * 3


def test_folds_of_many_subjects_plan_without_the_driver(spark):
    df = spark.range(100_000).select(F.col("id").alias("subject_id"), F.col("id").cast("double").alias("value"))
    for out in (P.loso_folds(df), P.fold_scale(df, "subject_id", "value")):
        assert out.limit(1).count() == 1 and len(out._jdf.queryExecution().analyzed().toString()) < 20_000


def test_samples_of_a_hot_label(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("label"), "id")
    got = {r["id"] for r in P.sample_per_label(df, 1200, ["id"]).collect()}
    assert got == {i for i in range(5000) if i % 10 == 0} | set(sorted(i for i in range(5000) if i % 10)[:1200])


def test_sliding_spectra_are_those_of_each_window(spark):
    rng = np.random.default_rng(8)
    rows = [("a", i, None if i % 211 == 5 else float(x)) for i, x in enumerate(100 + rng.normal(size=1500))] + [("b", i, 7.0) for i in range(200)] + [("c", i, float(np.sin(2 * np.pi * i / 8))) for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, t long, v double").withColumn("timestamp", F.col("t").cast("double"))
    arrays = W.window_arrays(W.count_windows(df, ["session_id"], ["timestamp"], 64, 16), ["session_id"], ["v"])
    plain = X.spectral(arrays.withColumn("values", F.transform("x", lambda r: r[0].cast("double"))), 1.0, 0.1)
    want = {(r["session_id"], r["window_no"]): (r["low_power"], r["high_power"], r["dominant_hz"]) for r in plain.collect()}
    for rows_a_block in (64, 400, 100_000):
        found = X.sliding_spectral(df, ["session_id"], ["timestamp"], "v", 64, 16, 1.0, 0.1, rows_a_block).collect()
        got = {(r["session_id"], r["window_no"]): (r["low_power"], r["high_power"], r["dominant_hz"]) for r in found}
        assert len(found) == len(got) and set(got) == set(want)
        assert all(got[w] == pytest.approx(want[w], rel=1e-4, abs=1e-4) for w in want)  # the arrays hold floats
    assert all(got[w] == (0.0, 0.0, 0.0) for w in got if w[0] == "b") and all(got[w][2] == 0.125 for w in got if w[0] == "c")
    # against the transform of the doubles themselves
    x = np.array([v for s, _, v in rows if s == "c"])
    for (s, k), (low, high, _) in got.items():
        if s == "c":
            y = x[k * 16 : k * 16 + 64]
            p, f = np.abs(np.fft.rfft(y - y.mean())) ** 2 / 64, np.fft.rfftfreq(64)
            assert (low, high) == pytest.approx((p[(f > 0) & (f < 0.1)].sum(), p[f >= 0.1].sum()), abs=1e-9)
