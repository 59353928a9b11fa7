"""What the review of round 3 found: inputs on which queries differed from their SQL, or grew too fast."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tidewatch.llm import nb_toxicity as N
from tidewatch.operators import cleanse as C
from tidewatch.operators import features as X
from tidewatch.operators import models as M
from tidewatch.sources import io


def events(path, rows):
    """events.parquet of (event_id, day, user_id, event_type, value)."""
    start = datetime.datetime(2024, 1, 1)
    frame = pd.DataFrame([(i, start + datetime.timedelta(days=t), u, e, v, "{}") for i, t, u, e, v in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame = frame.astype({"ts": "datetime64[us]", "user_id": "Int64"})
    frame.to_parquet(f"{path}/events.parquet")
    return str(path)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    row = lambda df: sorted(repr([None if pd.isna(x) else x for x in r]) for r in df.itertuples(index=False))
    return row(entry.queries()[name](spark, path).toPandas()), row(con.execute(entry.oracle_sql()[name]).fetchdf())


def test_apply_params_leaves_out_keys_without_parameters(spark, tmp_path):
    """User 2 has views after the fifteenth day only, user 1 a first click then; a null user meets no parameters."""
    rows = [(1, 1, 1, "view", 1.0), (2, 2, 1, "view", 4.0), (3, 20, 1, "view", 2.5), (4, 20, 2, "view", 3.0), (5, 21, 1, "click", 3.0), (6, 1, None, "view", 1.0), (7, 20, None, "view", 2.0)]
    ours, theirs = both(spark, events(tmp_path, rows), "c14_apply_params")
    assert len(theirs) == 1 and ours == theirs


SESSIONS = "subject_id long, timestamp double, event_id long, value double"


def sessions(spark):
    """300 short sessions, one without values, one that begins with missing ones, and one long one with a long gap."""
    rng = np.random.default_rng(5)
    rows = [(s, float(i * 40_000), i, None if s == 7 or (s == 8 and i < 5) or rng.random() < 0.2 else float(rng.normal())) for s in range(300) for i in range(int(rng.integers(1, 12)) + 6 * (s == 8))]
    rows += [(1000, float(i * 3_000), i, None if i < 45 or 100 < i < 320 or i > 560 else float(rng.normal())) for i in range(600)]
    return spark.createDataFrame(rows, SESSIONS)


def values(df, name):
    return df.toPandas().sort_values(["subject_id", "event_id"]).reset_index(drop=True)[["subject_id", "event_id", "value", name]]


def small_batches(spark, run):
    """run() with 7 rows in a batch, so that sessions and blocks lie across batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def calls_by_session(df):
    return "FlatMapGroups" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [40, 100_000])
def test_ema_of_many_sessions_in_batches(spark, rows):
    df = sessions(spark)
    smoothed = lambda: C.ema(df, ["subject_id"], ["timestamp", "event_id"], "value", 5.0, 1.0, rows=rows)
    assert not calls_by_session(smoothed())
    got = small_batches(spark, lambda: values(smoothed(), "ema"))
    a, want = 1 - np.exp(-1 / 5), []
    for _, x in got.groupby("subject_id")["value"]:
        y = np.nan
        for v in x:
            y = y if v != v else v if y != y else y + a * (v - y)
            want.append(y)
    np.testing.assert_allclose(got["ema"].to_numpy(), want, atol=1e-12)


def test_lowpass_of_many_sessions_in_batches(spark):
    df = sessions(spark)
    smoothed = lambda rows: C.lowpass(df, ["subject_id"], ["timestamp", "event_id"], "value", 0.3, 1.0, rows=rows)
    assert not calls_by_session(smoothed(50))
    got, whole = small_batches(spark, lambda: values(smoothed(50), "lowpass")), values(smoothed(10**6), "lowpass")
    some = whole.groupby("subject_id")["value"].transform("count") > 0
    assert len(got) == df.count() and whole["lowpass"].notna().equals(some) and not some.all()
    np.testing.assert_allclose(got["lowpass"].to_numpy(), whole["lowpass"].to_numpy(), atol=1e-6)


def test_toxicity_counts_and_vectors_in_small_parts():
    """A task counts hashes by class for itself, and vectors are made of some hundred texts at a time, whatever the batch."""
    rng = np.random.default_rng(1)
    h = [rng.choice(5000, int(rng.integers(0, 40)), replace=False).astype(np.int32) for _ in range(3000)]
    y = rng.integers(0, 2, 3000).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(h, pa.list_(pa.int32()))], names=["y", "h"])
    got = pa.Table.from_batches(N._counted([batch.slice(0, 1000), batch.slice(1000)])).to_pandas().set_index("h")
    both = [np.bincount(np.concatenate([x for x, k in zip(h, y, strict=True) if k == c]), minlength=5000) for c in (0, 1)]
    seen = np.flatnonzero(both[0] + both[1])
    assert list(got.index) == list(seen) and (got["n0"] == both[0][seen]).all() and (got["n1"] == both[1][seen]).all()
    kept = np.arange(0, 5000, 3, dtype=np.int32)
    r = rng.normal(size=len(kept))
    out = list(N._vectors([batch], kept, r, {0: 1.0, 1: 2.0}))
    assert max(b.num_rows for b in out) <= N.VECTORS
    rows = [v for b in out for v in b.to_pylist()]
    assert len(rows) == 3000
    for v, x, k in zip(rows, h, y, strict=True):
        at = np.sort(x[x % 3 == 0]) // 3
        assert v["label"] == k and v["w"] == k + 1 and v["features"]["indices"] == at.tolist() and v["features"]["values"] == r[at].tolist() and v["features"]["size"] == len(kept)


def test_svm_shape_and_margins_without_a_row_for_each_value(spark):
    """The variance comes from one pass over rows, and margins leave the task as one number each."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    d, n, var = M._shape(df)
    assert (d, n) == (3, 50) and abs(var - x.var()) < 1e-12
    assert M._shape(df.filter("id < 0")) == (1, 0, 1.0)
    cfg, w = M.Svm(frequencies=20), rng.normal(size=20)
    both = M.fourier_margins(M.fourier_features(df, d, 0.1, cfg), d, 0.1, cfg, w, 0.5).toPandas()
    np.testing.assert_allclose(both["margin"], np.vstack(both["rff"]) @ w + 0.5, atol=1e-12)


def test_folds_take_rows_from_one_deal_and_scale_inside_tasks(spark, monkeypatch):
    """A fit's plan has no expression for each value, and forests of all folds read the same dealt rows."""
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, int(rng.random() < 0.4), [float(v) for v in rng.normal(5, 3, 4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "subject_id int, window_id int, label int, features array<double>")
    seen = []

    def watched(kind):
        class Watched(kind):
            def fit(self, train):
                seen.append((train._jdf.queryExecution().toString(), train.select("features", "label", "weight").toPandas()))
                return super().fit(train)

        return Watched

    monkeypatch.setattr(M, "RandomForestClassifier", watched(M.RandomForestClassifier))
    monkeypatch.setattr(M, "LinearSVC", watched(M.LinearSVC))
    scores = M.loso_rf(df, M.Forest(trees=5), scaled=True, weighted=True, at_once=1)[0]
    M.loso_svm(df, M.Svm(frequencies=10, steps=3), weighted=True, at_once=1)
    plans = [p for p, _ in seen]
    assert len(plans) == 6 and scores.count() == 120
    assert not any("lambda" in p for p in plans) and all("InMemoryTableScan" in p for p in plans[:3])
    # the same rows in the same order as by expressions
    moments = M.fold_scale_raw(df, "subject_id", "features")
    for fold in range(3):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        train = M.apply_fold_scale_raw(df, moments, fold, "subject_id", "features", False)[0]
        want = train.repartition(n, "subject_id", "window_id").sortWithinPartitions("subject_id", "window_id").toPandas()
        got = seen[fold][1]
        np.testing.assert_allclose(np.vstack([v.toArray() for v in got["features"]]), np.vstack(want["features"]), atol=1e-12)
        assert (got["label"] == want["label"]).all()


def test_vectors_hold_nulls_and_short_lists_as_before(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [None, 4.0, 8.0]), (2, [5.0, float("nan"), 1.0]), (3, [2.0])], "id int, features array<double>")
    mean, std = np.array([1.0, 2.0, 3.0]), np.array([2.0, 1.0, 4.0])
    got = M._vectors(df, lambda v: M._numbers(v, (mean, std), 0.0), ["id"]).orderBy("id").toPandas()
    np.testing.assert_array_equal(np.vstack([v.toArray() for v in got["features"]]), [[0, 0, 0], [0, 2, 1.25], [2, np.nan, -0.5], [0.5, 0, 0]])
    d, n, var = M._shape(df.filter("id < 2"))
    x = np.array([1.0, 2.0, 3.0, 4.0, 8.0])
    assert (d, n) == (3, 2) and abs(var - x.var()) < 1e-12


def test_first_and_last_of_windows_without_sorted_rows(spark):
    """One number orders samples as it is, so windows are summed up by hash; null times are first, as in a struct."""
    rows = [("a", None, "lf", 7.0), ("a", 1.0, "lf", 2.0), ("a", 3.0, "lf", 5.0), ("a", 2.0, "hf", 4.0), ("b", 1.0, "hf", 3.0)]
    df = spark.createDataFrame(rows, "k string, timestamp double, signal_name string, value double")
    for make in (lambda o: X.autonomic(df, ["k"], order=o), lambda o: X.trend(df, ["k"], 2.0, o), lambda o: X.eda_reactivity(df, ["k"], 3.0, o)):
        assert "SortAggregate" not in make(("timestamp",))._jdf.queryExecution().toString()
        assert sorted(make(("timestamp",)).collect()) == sorted(make(("timestamp", "signal_name")).collect())


def test_append_reads_its_rows_once(spark, tmp_path):
    """Rows that meet a table are read once, whatever the folders compared and the tries."""
    schema = "subject_id int, signal_name string, timestamp double, value double, _source_file string"
    spark.createDataFrame([(i % 3, "eda", float(i), 1.0, "f") for i in range(30)], schema).write.parquet(str(tmp_path / "in"))
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    rows = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    io.append_bronze(rows.filter("timestamp < 10"), str(tmp_path / "bronze"))
    table = io.append_bronze(rows.mapInArrow(count, rows.schema), str(tmp_path / "bronze"))
    assert met.value == 30 and table.count() == 30
