"""Operators on small hand-made rows: boundaries, ties, nulls, degenerate groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.operators import cleanse as C
from tidewatch.operators import evaluate as E
from tidewatch.operators import features as X
from tidewatch.operators import labels as L
from tidewatch.operators import quality as Q
from tidewatch.operators import splits as P
from tidewatch.operators import windows as W
from tidewatch.operators.chunks import last_valid, row_index, running_sum


def series(spark, values, sid="a", step=1.0):
    return spark.createDataFrame([(sid, i * step, i, v) for i, v in enumerate(values)], "session_id string, timestamp double, event_id long, value double")


ORDER = ["timestamp", "event_id"]


@pytest.mark.parametrize(("n", "windows"), [(128, 0), (129, 1), (160, 1), (161, 2), (193, 3), (10, 0)])
def test_windows_leave_out_the_last_exact_fit(spark, n, windows):
    w = W.count_windows(series(spark, [1.0] * n), ["session_id"], ORDER)
    g = w.groupBy("window_no").count().collect()
    assert len(g) == windows and all(r["count"] == 128 for r in g)


def test_vote_ties_go_to_the_smallest_code(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 0, 1), ("a", 0, 2), ("a", 0, 1)], "session_id string, window_no int, code int")
    assert W.majority_label(df, ["session_id"], "code").first()["y"] == 1


def test_unknown_label_is_zero(spark):
    df = spark.createDataFrame([("syncope",), ("?",), (None,)], "label string")
    assert [r[0] for r in df.select(S.encode_label(F.col("label"))).collect()] == [2, 0, 0]


def test_null_session_is_left_out(spark):
    assert W.count_windows(series(spark, [1.0] * 130, None), ["session_id"], ORDER).count() == 0


@pytest.mark.parametrize(
    ("gap", "expected"), [(1.9, 1.0), (2.0, "line"), (4.9, "line"), (5.0, None), (60.0, None)]
)
def test_gap_rules(spark, gap, expected):
    df = spark.createDataFrame([("a", 0.0, 0, 1.0), ("a", gap / 2, 1, None), ("a", gap, 2, 3.0)], "session_id string, timestamp double, event_id long, value double")
    r = C.fill_gaps(df, ["session_id"], ORDER).filter("event_id = 1").first()
    assert r["value"] == (pytest.approx(2.0) if expected == "line" else expected)
    assert r["is_interpolated"] == (expected is not None) and r["interpolation_gap_seconds"] == pytest.approx(gap)


def test_long_gaps_go(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 1.0), ("a", 1.0, 1, None), ("a", 61.0, 2, 3.0)], "session_id string, timestamp double, event_id long, value double")
    out = C.drop_long_gaps(C.fill_gaps(df, ["session_id"], ORDER))
    assert sorted(r["event_id"] for r in out.collect()) == [0, 2]


def test_chunked_running_values_equal_whole_windows(spark):
    rng = np.random.default_rng(0)
    v = [None if rng.random() < 0.6 else float(i) for i in range(300)]
    df = series(spark, v, step=1000.0)
    for seconds in (500.0, 7000.0, 1e9):
        got = {r["event_id"]: r for r in last_valid(df, ["session_id"], ORDER, ["value"], True, seconds).collect()}
        back = {r["event_id"]: r for r in last_valid(df, ["session_id"], ORDER, ["value"], False, seconds).collect()}
        total = {r["event_id"]: r["s"] for r in running_sum(df, ["session_id"], ORDER, F.col("value"), "s", seconds).collect()}
        number = {r["event_id"]: r["rn"] for r in row_index(df, ["session_id"], ORDER, seconds=seconds).collect()}
        for i in range(300):
            seen = [x for x in v[: i + 1] if x is not None]
            later = [x for x in v[i:] if x is not None]
            assert got[i]["value_last"] == (seen[-1] if seen else None)
            assert back[i]["value_last"] == (later[0] if later else None)
            assert total[i] == (sum(seen) if seen else None) and number[i] == i


def test_fill_session_is_forward_then_backward(spark):
    out = C.fill_session(series(spark, [None, None, 5.0, None, 7.0, None]), ["session_id"], ["value"], ORDER)
    assert [r["value"] for r in out.orderBy("event_id").collect()] == [5, 5, 5, 5, 7, 7]


def test_resample_and_upsample(spark):
    df = series(spark, [float(i) for i in range(22)])
    blocks = C.resample_mean(df, ["session_id"], ORDER, "value", 10)
    assert [(r["block"], r["value"]) for r in blocks.orderBy("block").collect()] == [(0, 4.5), (1, 14.5)]
    up = [r["resampled"] for r in C.upsample_linear(df, blocks, ["session_id"], ORDER, 10).orderBy("rn").collect()]
    assert up[:6] == [4.5] * 6 and up[10] == pytest.approx(9.5) and up[15:] == [14.5] * 7


def test_constant_signal_normalises_to_zero(spark):
    z, params = C.normalize(series(spark, [3.0] * 5), ["session_id"])
    assert {r["z"] for r in z.collect()} == {0.0} and params.first()["std"] == 0


def test_regular_grid_has_no_drift(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.3, 2.0)], "session_id string, timestamp double, value double")
    assert [round(r["timestamp"], 9) for r in C.regular_grid(df, ["session_id"], 0.1).orderBy("timestamp").collect()] == [0.0, 0.1, 0.2, 0.3]


def test_moving_average_pads_with_zeros(spark):
    out = C.moving_average(series(spark, [4.0, 4.0, 4.0, 4.0]), ["session_id"], ORDER, "value", 4)
    assert [r["smooth"] for r in out.orderBy("event_id").collect()] == [2.0, 3.0, 4.0, 3.0]


def test_ema_and_lowpass(spark):
    x = [0.0, 1.0, None, 1.0]
    a = 1 - np.exp(-1 / 2.0)
    y = [r["ema"] for r in C.ema(series(spark, x), ["session_id"], ORDER, "value", 2.0, 1.0).orderBy("event_id").collect()]
    assert y == pytest.approx([0, a, a, a + a * (1 - a)])
    t = np.arange(400) / 50
    noisy = np.sin(2 * np.pi * 0.5 * t) + 0.5 * np.sin(2 * np.pi * 15 * t)
    got = [r["lowpass"] for r in C.lowpass(series(spark, noisy.tolist(), step=1 / 50), ["session_id"], ORDER, "value", 2.0, 50.0).orderBy("event_id").collect()]
    assert np.abs(np.array(got) - np.sin(2 * np.pi * 0.5 * t))[50:-50].max() < 0.02


def test_phase_labels_are_half_open_and_late_events_skipped(spark):
    df = series(spark, [0.0] * 10)
    log = [("a", 2.0, 4.0, 6.0, 8.0), ("a", 0.0, 1.0, 11.0, 12.0)]
    log = spark.createDataFrame(log, "session_id string, pre_start_s double, syncope_start_s double, recovery_start_s double, recovery_end_s double")
    got = [r["label"] for r in L.label_phases(df, log, bucket=3.0).orderBy("event_id").collect()]
    assert got == ["normal"] * 2 + ["pre_syncope"] * 2 + ["syncope"] * 2 + ["recovery"] * 2 + ["normal"] * 2


@pytest.mark.parametrize(("t", "window", "time"), [(-1.0, None, None), (0.0, 1, 1), (30.0, 1, 1), (31.0, 0, -1), (120.0, 0, -1), (121.0, 0, 0)])
def test_label_rules(spark, t, window, time):
    df = spark.createDataFrame([(1, 100.0 - t)], "subject_id int, window_start double")
    w = L.time_to_loc(df, spark.createDataFrame([(1, 100.0)], "subject_id int, loc_ts double"))
    for f, want in ((L.label_windows, window), (L.label_times, time)):
        got = [r["label"] for r in f(w).collect()]
        assert got == ([] if want is None else [want])


def test_subject_without_loss_is_zero(spark):
    w = L.time_to_loc(spark.createDataFrame([(1, 5.0)], "subject_id int, window_start double"), spark.createDataFrame([], "subject_id int, loc_ts double"))
    assert L.label_windows(w).first()["label"] == 0 and w.first()["time_to_loc"] == 0


def test_stage_at_the_windows_own_time_counts(spark):
    w = spark.createDataFrame([(1, 5.0), (1, 10.0)], "subject_id int, window_start double")
    st = spark.createDataFrame([(1, 3, 10.0)], "subject_id int, stage int, onset_ts double")
    got = L.stage_context(w, st).orderBy("window_start").collect()
    assert [(r["stage"], r["time_in_stage"]) for r in got] == [(None, None), (3, 0.0)]


def test_sliding_moments_equal_plain_statistics(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", float(t), float(v)) for t, v in zip(rng.uniform(0, 50, 300), rng.normal(1e6, 1, 300), strict=True)], "session_id string, timestamp double, value double")
    fast = {r["window_start"]: r for r in X.sliding_moments(df, ["session_id"], 10, 1.0).collect()}
    plain = X.window_stats(W.time_windows(df, 10.0, 1.0), ["session_id", "window_start"]).collect()
    assert len(fast) == len(plain)
    for r in plain:
        f = fast[r["window_start"]]
        assert f["n"] == r["n"] and f["mean"] == pytest.approx(r["mean"]) and f["std"] == pytest.approx(r["std"], rel=1e-6)


def test_ratio_with_zero_base_is_null(spark):
    df = spark.createDataFrame([("w", 0.0, "lf", 1.0), ("w", 0.0, "hf", 0.0)], "k string, timestamp double, signal_name string, value double")
    assert X.autonomic(df, ["k"]).first()["lf_hf"] is None


def test_spectral_finds_the_tone(spark):
    x = np.sin(2 * np.pi * 4 * np.arange(128) / 32).tolist()
    r = X.spectral(spark.createDataFrame([(x,), ([],), (None,)], "values array<double>"), 32.0, 8.0).collect()
    assert r[0]["dominant_hz"] == 4.0 and r[0]["low_power"] > 100 * r[0]["high_power"]


@pytest.mark.parametrize(("n", "want"), [(1, "train"), (2, "train train"), (5, "train train train val test"), (10, "train " * 6 + "val val test test")])
def test_temporal_split(spark, n, want):
    df = spark.createDataFrame([(1, float(i)) for i in range(n)], "subject_id int, window_start double")
    assert [r["split_set"] for r in P.temporal_split(df).orderBy("window_start").collect()] == want.split()


def test_fold_statistics_by_difference(spark):
    rng = np.random.default_rng(2)
    data = [(int(s), float(v)) for s, v in zip(rng.integers(0, 4, 200), rng.normal(1e5, 0.5, 200), strict=True)]
    m = {r["fold"]: r for r in P.fold_moments(spark.createDataFrame(data, "subject_id int, v double"), "subject_id", "v").collect()}
    for s in range(4):
        x = np.array([v for k, v in data if k != s])
        assert m[s]["n"] == len(x) and m[s]["mean"] == pytest.approx(x.mean()) and m[s]["std"] == pytest.approx(x.std(), rel=1e-5)


def test_folds_do_not_leak_and_weights_may_be_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "subject_id int, label int")
    assert P.leakage(P.loso_folds(df)).count() == 0
    w = {r["fold"]: r for r in P.fold_weights(df).collect()}
    assert w[1]["pos_weight"] is None and w[2]["pos_weight"] == 1.0


def scored(spark, rows):
    return spark.createDataFrame(rows, "fold int, window_id int, y int, p double, time_to_loc double")


def test_fold_metrics(spark):
    rows = [(1, 0, 1, 0.5, 20.0), (1, 1, 1, 0.9, 10.0), (1, 2, 0, 0.5, 99.0), (1, 3, 0, 0.1, 200.0), (2, 4, 0, 0.7, 0.0)]
    r = {x["fold"]: x for x in E.fold_results(scored(spark, rows)).collect()}
    assert r[1]["auc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4) and r[2]["auc"] is None
    assert r[1]["first_detection_time"] == 99.0 and r[2]["first_detection_time"] is None
    assert r[1]["false_alarm_rate"] == pytest.approx(1800.0)
    only_pos = E.false_alarm_rate(scored(spark, [(1, 0, 1, 0.9, 1.0)])).first()
    assert only_pos["false_alarm_rate"] == 0
    none = E.sensitivity_bins(E.first_detection(scored(spark, [(2, 4, 0, 0.7, 0.0)])))
    assert all(x["sensitivity"] is None for x in none.collect())


def test_confusion_has_all_cells(spark):
    assert E.confusion(scored(spark, [(1, 0, 1, 0.9, 0.0)])).count() == 4


def test_gates(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = Q.nan_gate(df, ["x"]).first()
    assert r["n_bad"] == 2 and not r["ok"]
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert {r["side"]: r["n"] for r in Q.same_rows(a, a.limit(1)).collect()} == {"a": 1, "b": 0}
    d = {r["label"]: r for r in Q.label_distribution(spark.createDataFrame([(1,)], "label int")).collect()}
    assert d[0]["n"] == 0 and d[1]["percent"] == 100.0
