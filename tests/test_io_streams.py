"""Files, idempotent appends and streams against the batch answer."""

import inspect
import random
import time
from datetime import datetime, timedelta
from multiprocessing.pool import ThreadPool

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models as M
from tidewatch.plans.queries import QUERIES
from tidewatch.sources import io
from tidewatch.streaming import streams as T


def test_signal_files_and_idempotent_append(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "S7_heart_rate.csv").write_text("timestamp,value\n0.0,60\n1.0,NaN\n1.0,61\n")
    rows = io.read_signals(spark, str(tmp_path / "in"))
    got = rows.orderBy("timestamp").first()
    assert (got["subject_id"], got["signal_name"], got["_source_file"]) == (7, "heart_rate", "S7_heart_rate.csv")
    assert rows.filter("value is null").count() == 1
    rows = io.with_ingest_meta(rows, "2024-01-01")
    path = str(tmp_path / "bronze")
    assert io.append_bronze(rows, path).count() == 2
    assert io.append_bronze(rows, path).count() == 2


def test_marks(spark, tmp_path):
    (tmp_path / "S3_LOC.csv").write_text("timestamp\n450.0\n")
    assert io.read_marks(spark, str(tmp_path), "loc_ts").first().asDict() == {"subject_id": 3, "loc_ts": 450.0}


def test_samples_and_windows_round_trip(spark, tmp_path):
    row = (0.5, 1, "walking", "normal", "none", *[1.0] * 8, None, "normal_0000", False)
    df = spark.createDataFrame([row], io.SAMPLES)
    io.write_samples(df, str(tmp_path / "s"))
    assert io.read_samples(spark, str(tmp_path / "s")).collect() == df.collect()
    w = spark.createDataFrame([("a", 0, [[1.0, 2.0]])], "session_id string, window_no int, x array<array<float>>")
    io.write_windows(w, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).collect() == w.collect()
    g = spark.createDataFrame([(1, "w0", 1.5, "train")], "subject_id int, window_id string, f double, split_set string")
    io.write_gold(g, str(tmp_path / "g"), {"params": g.select("f")})
    assert spark.read.json(str(tmp_path / "g" / "params")).first()["f"] == 1.5
    assert io.retain(io.with_ingest_meta(g, "2024-01-01"), F.lit("2024-05-01").cast("timestamp")).count() == 0


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, tmp_path):
    to = str(tmp_path / "events")
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 2, "view", float(i), "") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.union(df).write.parquet(to)
    return to


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_stream_drops_duplicates_and_matches_batch(spark, folder):
    assert drained(T.stream_bronze(spark, folder, SCHEMA), "t_bronze").count() == 60
    rows = T.stream_bronze(spark, folder, SCHEMA, late="1 second")
    got = {(str(r["window_start"]), r["user_id"]): r["mean"] for r in drained(T.stream_features(rows, "5 seconds", None), "t_feat").collect()}
    batch = spark.read.parquet(folder).dropDuplicates(["event_id"]).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(str(r["window_start"]), r["user_id"]): r["mean"] for r in T.stream_features(batch, "5 seconds", None).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_stream_alerts(spark, tmp_path):
    p = [0.9, 0.9, 0.9, 0.9, 0.1, 0.9]
    df = spark.createDataFrame([(1, f"2024-01-01 00:00:0{i}", x) for i, x in enumerate(p)], "user_id long, ts string, p double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "a"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "a")).withWatermark("ts", "0 seconds")
    out = drained(T.stream_alerts(rows), "t_alerts")
    assert [(r["ts"].second, r["state"]) for r in out.orderBy("ts").collect()] == [(2, "raised"), (4, "cleared")]


def test_alerts_of_unordered_batches_are_those_of_the_ordered_rows(spark, tmp_path):
    """Rows up to 50 s late, dealt over twelve micro-batches, several at one time: the batch answer, ties by id."""
    rng, base = random.Random(1), datetime(2024, 1, 1)
    rows = [(u * 1000 + i, u, base + timedelta(seconds=rng.randrange(0, 600)), rng.choice([0.1, 0.9, 0.9])) for u in range(5) for i in range(120)]
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 50)))
    late = (9999, 0, base - timedelta(hours=1), 0.9)  # after the watermark: dropped
    schema = "event_id long, user_id long, ts timestamp, p double"
    for k in range(12):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50] + [late] * (k == 8), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "60 seconds")
    got = sorted((r["user_id"], r["ts"], r["state"]) for r in drained(T.stream_alerts(stream, 3, 0.5, "event_id"), "t_unordered").collect())
    want, closed = [], max(r[2] for r in rows) - timedelta(seconds=60)
    for u in range(5):
        run, on = 0, False
        for _, _, ts, p in sorted((r for r in rows if r[1] == u), key=lambda r: (r[2], r[0])):
            run = run + 1 if p >= 0.5 else 0
            if (run >= 3 and not on) or (on and not run):
                on = not on
                want.append((u, ts, "raised" if on else "cleared"))
    assert got == sorted(w for w in want if w[1] <= closed) and len(got) > 50


def test_gold_sink_is_safe_to_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "hr", 0.0, 60.0)], "subject_id int, signal_name string, timestamp double, value double")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # a new checkpoint replays everything
        T.stream_gold(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "gold"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert io.read_bronze(spark, str(tmp_path / "gold")).count() == 1


def test_appends_at_the_same_time_add_each_key_once(spark, tmp_path):
    path = str(tmp_path / "bronze")
    rows = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 5).cast("int").alias("subject_id"), F.lit("hr").alias("signal_name"), F.col("id").cast("double").alias("timestamp"), F.lit(1.0).alias("value"))
    with ThreadPool(4) as pool:
        pool.map(lambda k: io.append_bronze(rows(100 * k, 100 * k + 300), path), range(4))
    table = io.read_bronze(spark, path)
    assert table.count() == table.select(*io.BRONZE_KEY).distinct().count() == 600
    version = io._latest(spark, path)[0]
    assert not io._commit(spark, path, version, ["other"]) and io._latest(spark, path)[0] == version
    assert io.append_bronze(rows(0, 600), path).count() == 600 and io._latest(spark, path)[0] == version


def test_a_writer_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bronze")
    row = lambda t: spark.createDataFrame([(1, "hr", t, 60.0)], "subject_id int, signal_name string, timestamp double, value double")
    io.append_bronze(row(0.0), path)
    monkeypatch.setattr(io, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        io.append_bronze(row(1.0), path)
    assert io.read_bronze(spark, path).count() == 1


def test_window_files_follow_bytes_and_not_users(spark, tmp_path):
    w = spark.range(4000).select(F.lit("s").alias("session_id"), F.col("id").alias("user_id"), F.lit(0).alias("window_no"), F.lit(1).alias("y"), F.array(F.array(F.lit(1.0).cast("float"))).alias("x"))
    io.write_windows(w, str(tmp_path / "w"))
    assert io.read_windows(spark, str(tmp_path / "w")).exceptAll(w).count() == 0
    assert len(list((tmp_path / "w").rglob("*.parquet"))) <= 40


def test_models(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 2))
    rows = [(int(i % 3), int(i), int((a * a + b * b) < 1.2), [float(a), float(b)]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "subject_id int, window_id int, label int, features array<double>")
    scores, weights = M.loso_rf(df, M.Forest(trees=10), folds=[0])
    got = scores.collect()
    assert len(got) == 80 and np.mean([(r["p"] > 0.5) == r["y"] for r in got]) > 0.8 and weights.count() == 2
    svm = M.loso_svm(df, M.Svm(frequencies=100, steps=20), folds=[1]).collect()
    one = M.loso_rf(df, M.Forest(trees=4), at_once=1)
    many = M.loso_rf(df, M.Forest(trees=4), at_once=3)
    assert sorted(one[0].collect()) == sorted(many[0].collect()) and one[0].count() == 240 and sorted(one[1].collect()) == sorted(many[1].collect())
    # the summary of importances, by SQL over the written ones
    one[1].write.parquet(str(tmp_path / "imp"))
    want = duckdb.sql(f"select feature, avg(importance), stddev_pop(importance) from '{tmp_path}/imp/*.parquet' group by 1 order by 2 desc, 1").fetchall()
    assert [tuple(r) for r in M.importance_summary(one[1]).collect()] == [pytest.approx(w) for w in want]
    assert np.mean([(r["p"] > 0.5) == r["y"] for r in svm]) > 0.8
    flat = df.select("label", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    M.fit_pipeline(flat, ["a", "b"], str(tmp_path / "m"), M.Forest(trees=5))
    assert M.score(flat, str(tmp_path / "m")).filter("confidence between 0.5 and 1").count() == 240


def test_model_queries_score_every_subject_with_default_settings(spark, monkeypatch):
    rf, svm, fit, seen = M.loso_rf, M.loso_svm, M.fit_pipeline, []

    def small(run, cfg, quick):
        def call(df, *args, **kwargs):
            bound = inspect.signature(run).bind(df, *args, **kwargs)
            bound.apply_defaults()
            seen.append(bound.arguments["cfg"] == cfg)
            bound.arguments["cfg"] = quick
            return run(*bound.args, **bound.kwargs)

        return call

    monkeypatch.setattr(M, "loso_rf", small(rf, M.Forest(), M.Forest(trees=2)))
    monkeypatch.setattr(M, "loso_svm", small(svm, M.Svm(), M.Svm(frequencies=8, steps=2)))
    monkeypatch.setattr(M, "fit_pipeline", small(fit, M.Forest(), M.Forest(trees=2)))
    sf = "/root/testdata/sf0.001"
    want = sorted((r["vec_id"] % 9, r["vec_id"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect())
    for name in ("m01_loso_rf", "m02_loso_svm"):
        assert sorted((r["fold"], r["window_id"]) for r in QUERIES[name](spark, sf).collect()) == want
    assert QUERIES["m04_score"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert seen == [True, True, True]
