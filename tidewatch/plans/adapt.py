"""The driver's tables as sensor tables: events as signals, sessions, marks and scored windows; embeddings as features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 UTC
DAY = 86_400.0
WEEK = 7 * DAY
SIGNALS = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, signal_name, timestamp (s), value, event_id, label."""
    label = F.when(F.col("event_type").isin("view", "click"), "normal").when(F.col("event_type") == "signup", "pre_syncope")
    label = label.when(F.col("event_type") == "error", "syncope").when(F.col("event_type") == "purchase", "recovery")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(1e6)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("signal_name"), t.alias("timestamp"), "value", "event_id", label.alias("label")
    )


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals with every seventh value missing."""
    return signals(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id (the event type), user_id, timestamp, value, event_id, activity, label: one long series for each session.

    In this form a label is that of the event's number, so that windows of a session mix labels.
    """
    names = F.array(*[F.lit(x) for x in ("normal", "pre_syncope", "syncope", "recovery", "other")])
    label = F.element_at(names, (F.floor(F.col("value")) % 5 + 1).cast("int"))
    s = signals(spark, sf_dir)
    return s.select(F.col("signal_name").alias("session_id"), F.col("subject_id").alias("user_id"), "timestamp", "value", "event_id", F.col("label").alias("activity"), label.alias("label"))


def loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, loc_ts): a subject's first error."""
    return signals(spark, sf_dir).filter("signal_name = 'error'").groupBy("subject_id").agg(F.min("timestamp").alias("loc_ts"))


def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).filter("signal_name = 'signup'").select("subject_id", F.col("timestamp").alias("roc_ts"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, window_id, y, p, time_to_loc: each event as a scored window."""
    from ..operators.labels import label_windows, time_to_loc

    w = signals(spark, sf_dir).withColumn("window_start", F.col("timestamp"))
    w = label_windows(time_to_loc(w, loc(spark, sf_dir)), warn=3 * DAY)
    p = F.round(1 - F.exp(-F.col("value") / 50) + 1e-9, 4)
    return w.select((F.col("subject_id") % 9).alias("fold"), F.col("event_id").alias("window_id"), F.col("label").alias("y"), p.alias("p"), "time_to_loc")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, window_id, label, features of embeddings, for models."""
    e = read(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 9).alias("subject_id"), F.col("vec_id").alias("window_id"), (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features"))
