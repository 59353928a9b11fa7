"""Chunks and blocks give what whole sessions give, and no row is lost to null keys, null times or short sessions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import chunks
from tidewatch.operators import cleanse as C
from tidewatch.operators import features as X
from tidewatch.operators import labels as L
from tidewatch.operators import models as M
from tidewatch.operators import quality as Q
from tidewatch.operators import splits as P
from tidewatch.operators import windows as W

ORDER = ["timestamp", "event_id"]
SCHEMA = "subject_id string, timestamp double, event_id long, value double, label string"


@pytest.fixture(scope="module")
def walk(spark):
    """Two long sessions, one of a single row; irregular times, ties, missing values."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("a", 400), ("b", 250), ("c", 1)):
        t = np.cumsum(rng.choice([0.0, 1.0, 7.0, 4000.0], n, p=[0.1, 0.6, 0.25, 0.05]))
        v = np.round(np.cumsum(rng.normal(size=n)), 3)
        rows += [(s, float(t[i]), i, None if rng.random() < 0.2 else float(v[i]), rng.choice(["x", "y"], p=[0.8, 0.2])) for i in range(n)]
    return spark.createDataFrame([(s, t, i, v, str(x)) for s, t, i, v, x in rows], SCHEMA).cache()


def whole(df):
    return df.toPandas().sort_values(["subject_id", *ORDER]).reset_index(drop=True)


def same(got, want, cols):
    for c in cols:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_neighbours_gaps_and_runs(spark, walk):
    want = whole(walk)
    g = want.groupby("subject_id")["timestamp"]
    want["gap_before"], want["gap_after"] = g.diff(), -g.diff(-1)
    same(whole(C.gaps(walk, ["subject_id"], ORDER, 3600.0)), want, ["gap_before", "gap_after"])
    new = (want["label"] != want["label"].shift()) | (want["subject_id"] != want["subject_id"].shift())
    runs = want.groupby(["subject_id", new.cumsum()]).agg(label=("label", "first"), start=("timestamp", "min"), end=("timestamp", "max"), n=("label", "size"))
    got = W.phase_runs(walk, ["subject_id"], ORDER).collect()
    assert sorted((r["subject_id"], r["label"], r["start"], r["end"], r["n"]) for r in got) == sorted((k[0], *r) for k, r in zip(runs.index, runs.itertuples(index=False, name=None), strict=True))


@pytest.mark.parametrize("rows", [7, 64, 10**6])
def test_smoothing_in_blocks(spark, walk, rows):
    want = whole(walk)
    want["smooth"] = np.nan
    want["ema"] = np.nan
    a = 1 - np.exp(-1 / 5.0)
    for _, g in want.groupby("subject_id"):
        v = g["value"].to_numpy()
        padded = np.concatenate([np.zeros(3), np.nan_to_num(v), np.zeros(2)])
        some = np.concatenate([np.zeros(3, bool), ~np.isnan(v), np.zeros(2, bool)])
        total = [padded[i : i + 6].sum() / 6 if some[i : i + 6].any() else np.nan for i in range(len(v))]
        want.loc[g.index, "smooth"] = total
        y, out = np.nan, []
        for x in v:
            y = y if np.isnan(x) else x if np.isnan(y) else y + a * (x - y)
            out.append(y)
        want.loc[g.index, "ema"] = out
    same(whole(C.moving_average(walk, ["subject_id"], ORDER, "value", 6, rows=rows)), want, ["smooth"])
    same(whole(C.ema(walk, ["subject_id"], ORDER, "value", 5.0, 1.0, rows=rows)), want, ["ema"])


def test_lowpass_in_blocks_equals_the_whole_session(spark):
    rng = np.random.default_rng(4)
    v = np.cumsum(rng.normal(size=6000))
    rows = [("a", float(i), i, None if i % 11 == 0 else float(x), "x") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (whole(C.lowpass(df, ["subject_id"], ORDER, "value", 0.1, 1.0, rows=n))["lowpass"].to_numpy() for n in (10**6, 500))
    assert len(many) == 6000 and np.abs(one - many).max() < 1e-6 * np.abs(v).max()
    filled = pd.Series([np.nan if i % 11 == 0 else x for i, x in enumerate(v)]).interpolate(limit_direction="both").to_numpy()
    assert np.abs(one - filled)[100:-100].mean() < np.abs(filled - filled.mean()).mean() / 5


def test_beats_rate_of_change_and_split(spark, walk):
    want = whole(walk)
    want["beat_time"] = want.groupby("subject_id")["value"].transform(lambda v: v.fillna(0).cumsum())
    want.loc[want.groupby("subject_id")["value"].transform(lambda v: v.notna().cumsum()) == 0, "beat_time"] = np.nan
    same(whole(S.beats(walk, ["subject_id"], ORDER, "value")), want, ["beat_time"])
    roc = []
    for r in want.itertuples():
        past = want[(want["subject_id"] == r.subject_id) & want["value"].notna() & (want["timestamp"] + 60 <= r.timestamp)]
        last = max(zip(past["timestamp"], past["value"], strict=True), default=None)
        roc.append((r.value - last[1]) / (r.timestamp - last[0]) if last else np.nan)
    want["roc"] = roc
    same(whole(X.rate_of_change(walk, ["subject_id"], 60)), want, ["roc"])
    n = want.groupby("subject_id")["value"].transform("size")
    share = want.groupby("subject_id").cumcount() / n
    got = whole(P.temporal_split(walk, order=ORDER))
    assert (got["split_set"] == np.where(share < 0.6, "train", np.where(share < 0.8, "val", "test"))).all()


def test_stage_and_recovery_marks(spark, walk):
    want = whole(walk)
    stages = [(s, k, 900.0 * k) for s in ("a", "b") for k in range(1, 40)]
    got = whole(L.stage_context(walk, spark.createDataFrame(stages, "subject_id string, stage int, onset_ts double"), "timestamp"))
    k = np.minimum(np.floor(want["timestamp"] / 900.0), 39)
    known = (k >= 1) & (want["subject_id"] != "c")
    assert (got["stage"].fillna(-1) == np.where(known, k, -1)).all()
    loc = spark.createDataFrame([("a", 10.0), ("a", 5e5), ("b", 7.0)], "subject_id string, loc_ts double")
    roc = spark.createDataFrame([("a", 5e5), ("a", 4e5), ("b", 6.0)], "subject_id string, roc_ts double")
    assert sorted((r["subject_id"], r["loc_ts"], r["roc_ts"]) for r in L.loc_roc_intervals(loc, roc).collect()) == [("a", 10.0, 4e5), ("a", 5e5, 5e5), ("b", 7.0, None)]


def test_null_keys_and_times_stay(spark):
    rows = [("a", None, 0, 1.0, None), (None, 3.0, 1, 2.0, None), (None, None, 2, None, "x"), ("a", 5.0, 3, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for out in (
        C.fill_session(df, ["subject_id"], ["value"], ORDER), C.normalize(df, ["subject_id"])[0], chunks.row_index(df, ["subject_id"], ORDER), C.gaps(df, ["subject_id"], ORDER),
        P.class_weights(df), C.flag_spikes(df, ["subject_id"], "value"), C.flag_iqr(df, ["subject_id"]), C.moving_average(df, ["subject_id"], ORDER, "value", 3),
        C.ema(df, ["subject_id"], ORDER, "value", 1.0, 1.0), C.lowpass(df, ["subject_id"], ORDER, "value", 0.1, 1.0), S.beats(df, ["subject_id"], ORDER, "value"), P.temporal_split(df, order=ORDER),
    ):
        assert sorted(r["event_id"] for r in out.collect()) == [0, 1, 2, 3]
    filled = {r["event_id"]: r["value"] for r in C.fill_session(df, ["subject_id"], ["value"], ORDER).collect()}
    assert filled == {0: 1.0, 1: 2.0, 2: 2.0, 3: 1.0}
    assert {r["label"]: r["class_weight"] for r in P.class_weights(df).collect()} == {None: 1.0, "x": 1.0}


def test_sessions_shorter_than_a_block_stay(spark):
    df = spark.createDataFrame([("a", float(i), i, float(i), "x") for i in range(20)] + [("b", float(i), 100 + i, 1.0, "x") for i in range(5)], SCHEMA)
    blocks = C.resample_mean(df, ["subject_id"], ORDER, "value", 10)
    got = {r["event_id"]: r["resampled"] for r in C.upsample_linear(df, blocks, ["subject_id"], ORDER, 10).collect()}
    assert len(got) == 25 and all(got[100 + i] is None for i in range(5)) and got[19] == 14.5


def test_overlapping_events_keep_each_sample_once(spark):
    df = spark.createDataFrame([("s", float(i), i) for i in range(100)], "session_id string, timestamp double, event_id long")
    log = spark.createDataFrame([("s", 10.0, 20.0, 40.0, 60.0), ("s", 35.0, 50.0, 55.0, 58.0)], "session_id string, pre_start_s double, syncope_start_s double, recovery_start_s double, recovery_end_s double")
    got = {r["event_id"]: r["label"] for r in L.label_phases(df, log, 9.0).collect()}
    want = ["normal"] * 100
    for a, b, c, e in ((10, 20, 40, 60), (35, 50, 55, 58)):
        want[a:b], want[b:c], want[c:e] = ["pre_syncope"] * (b - a), ["syncope"] * (c - b), ["recovery"] * (e - c)
    assert L.label_phases(df, log, 9.0).count() == 100 and [got[i] for i in range(100)] == want


def test_sliding_stats_equal_plain_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(t), 0, None if rng.random() < 0.1 else float(v), "x") for t, v in zip(rng.uniform(-3, 50, 300), rng.normal(1e3, 1, 300), strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    fast = {r["window_start"]: r for r in X.sliding_stats(df, ["subject_id"], 10, 1.0, extra=True).collect()}
    plain = X.window_stats(W.time_windows(df.filter("value is not null"), 10.0, 1.0), ["subject_id", "window_start"], True).collect()
    assert len(fast) == len(plain)
    for r in plain:
        for c in ("n", *X.STATISTICS, "range", "cv"):
            assert fast[r["window_start"]][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9), c


def test_raw_windows_are_scaled_by_the_training_side(spark):
    rng = np.random.default_rng(2)
    x = rng.normal([5, -3], [2, 0], (12, 4, 2))
    df = spark.createDataFrame([(i % 3, i, x[i].tolist()) for i in range(12)], "subject_id int, window_id int, x array<array<double>>")
    moments = P.fold_scale_raw(df, "subject_id", "x", steps=True)
    for fold in range(3):
        train = x[[i for i in range(12) if i % 3 != fold]].reshape(-1, 2)
        std = np.where(train.std(0) < 1e-12, 1, train.std(0))
        for side in P.apply_fold_scale_raw(df, moments, fold, "subject_id", "x"):
            for r in side.collect():
                assert np.allclose(r["x"], (x[r["window_id"]] - train.mean(0)) / std)


def test_leakage_is_found(spark):
    folds = spark.createDataFrame([(1, 1, "test"), (1, 2, "train"), (2, 2, "test"), (2, 2, "train")], "fold int, subject_id int, role string")
    assert [tuple(r) for r in P.leakage(folds).collect()] == [(2, 2)]


def test_schema_check_reads_rows(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r["column"]: (r["n_missing"], r["ok"]) for r in Q.check_schema(df, StructType.fromDDL("a int not null, b string not null, c int")).collect()}
    assert got == {"a": (0, True), "b": (1, False), "c": (2, False)}


def fold_rows(spark, n=90):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) * [1, 100, 0.01] + np.outer(y, [2, 0, 0])
    rows = [(i % 3, i, int(y[i]), x[i].tolist(), float(i % 50) if y[i] else 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id int, window_id int, label int, features array<double>, time_to_loc double")


def test_svm_is_scaled_and_has_the_usual_c(spark):
    df = fold_rows(spark)
    p = {r["window_id"]: (r["y"], r["p"]) for r in M.loso_svm(df, M.Svm(frequencies=100), folds=[0]).collect()}
    assert len(p) == 30 and np.mean([(q >= 0.5) == y for y, q in p.values()]) > 0.75  # the first feature tells, the second is loud


def test_training_run_as_one_job(spark):
    run = M.loso_run(fold_rows(spark), M.Forest(trees=10))
    assert run.scores.count() == 90 and run.results.count() == 3
    assert {r["metric"]: r["mean"] for r in run.summary.collect()}["auc"] > 0.7
    assert run.importances.first()["feature"] == 0 and run.bins.count() == 4


def test_gold_is_the_same_on_a_second_run(spark):
    from tidewatch.plans import adapt as A
    from tidewatch.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    a, b = (QUERIES["signals_to_gold"](spark, sf) for _ in range(2))
    assert all(r["n"] == 0 for r in Q.same_rows(a, b).collect()) and a.count() > 0 and A.SIGNALS
