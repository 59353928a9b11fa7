"""Labels from event logs and marks: range joins, time to event, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import joined, last_valid

PHASES = [("pre_syncope", "pre_start_s", "syncope_start_s"), ("syncope", "syncope_start_s", "recovery_start_s"), ("recovery", "recovery_start_s", "recovery_end_s")]


def label_phases(samples: DataFrame, event_log: DataFrame, bucket: float = 3600.0, time: str = "timestamp") -> DataFrame:
    """Adds label by the event log's phases, half-open; outside them `normal`. Events whose recovery starts past the
    session's last sample are skipped. Where events overlap, the one that starts later counts; every sample stays once.

    An equi-join on session and time bucket, not a comparison of all pairs: each phase is listed once for each bucket it
    touches, and a sample meets the list of its bucket.
    """
    ends = samples.groupBy("session_id").agg(F.max(time).alias("_end"))
    log = event_log.join(ends, "session_id").filter(F.col("recovery_start_s") <= F.col("_end"))
    phases = F.explode(F.array(*[F.struct(F.lit(name).alias("_label"), F.col(a).alias("_from"), F.col(b).alias("_to")) for name, a, b in PHASES]))
    spans = log.select("session_id", F.col("pre_start_s").alias("_start"), phases.alias("p")).select("session_id", "_start", "p.*").filter("_to > _from")
    touched = F.sequence(F.floor(F.col("_from") / bucket).cast("long"), F.floor(F.col("_to") / bucket).cast("long"))
    listed = spans.withColumn("_bucket", F.explode(touched)).groupBy("session_id", "_bucket").agg(F.sort_array(F.collect_list(F.struct("_start", "_from", "_to", "_label"))).alias("_spans"))
    rows = samples.drop("label").withColumn("_bucket", F.floor(F.col(time) / bucket).cast("long"))
    within = F.filter("_spans", lambda p: (F.col(time) >= p["_from"]) & (F.col(time) < p["_to"]))
    label = F.coalesce(F.try_element_at(within, F.lit(-1))["_label"], F.lit("normal"))
    return joined(rows, listed, ["session_id", "_bucket"], "left").withColumn("label", label).drop("_bucket", "_spans")


def derive_event_log(samples: DataFrame, time: str = "timestamp") -> DataFrame:
    """(session_id, start, end and length of each phase) from labelled samples; nulls for phases that don't occur."""
    aggs = []
    for name, *_ in PHASES:
        t = F.when(F.col("label") == name, F.col(time))
        aggs += [F.min(t).alias(f"{name}_start_s"), F.max(t).alias(f"{name}_end_s"), (F.max(t) - F.min(t)).alias(f"{name}_dur_s")]
    return samples.groupBy("session_id").agg(*aggs).filter("syncope_start_s is not null")


def time_to_loc(windows: DataFrame, loc: DataFrame, anchor: str = "start", size: float = 60.0) -> DataFrame:
    """Adds time_to_loc (0 where the subject has none) and has_loc; loc: (subject_id, loc_ts), one row a subject."""
    at = F.col("window_start") + (F.lit(size) if anchor == "end" else F.lit(0.0))
    joined = windows.join(loc, "subject_id", "left")
    return joined.withColumn("time_to_loc", F.coalesce(F.col("loc_ts") - at, F.lit(0.0))).withColumn("has_loc", F.col("loc_ts").isNotNull()).drop("loc_ts")


def label_windows(df: DataFrame, warn: float = 30.0) -> DataFrame:
    """Adds label: 1 within `warn` before the loss, 0 earlier or without one; windows after it are left out."""
    t = F.col("time_to_loc")
    return df.filter(~F.col("has_loc") | (t >= 0)).withColumn("label", F.when(F.col("has_loc") & (t <= warn), 1).otherwise(0))


def label_times(df: DataFrame, positive: float = 30.0, negative: float = 120.0) -> DataFrame:
    """Adds label by time to the loss: <= positive 1, > negative 0, -1 between; rows after it are left out."""
    t = F.col("time_to_loc")
    out = F.when(~F.col("has_loc"), 0).when(t <= positive, 1).when(t > negative, 0).otherwise(-1)
    return df.filter(~F.col("has_loc") | (t >= 0)).withColumn("label", out)


def label_shift(windows: DataFrame, loc: DataFrame, offsets: Sequence[float], warn: float = 30.0) -> DataFrame:
    """(offset, n, n_changed): how many windows' labels change when the loss is marked `offset` later."""
    t = F.col("loc_ts") - F.col("window_start")
    label = lambda s: F.when(t + s < 0, -1).when(t + s <= warn, 1).otherwise(0)
    base = windows.join(loc, "subject_id").withColumn("_base", label(F.lit(0.0)))
    shifted = base.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    return shifted.groupBy("offset").agg(F.count("*").alias("n"), F.count_if(label(F.col("offset")) != F.col("_base")).alias("n_changed"))


def has_loc(windows: DataFrame) -> DataFrame:
    return windows.groupBy("subject_id").agg(F.bool_or(F.col("label") == 1).alias("has_loc"))


def stage_context(windows: DataFrame, stages: DataFrame, time: str = "window_start") -> DataFrame:
    """Adds stage and time_in_stage: the last stage with onset_ts at or before the window's time, null before the first.

    As-of join by union of both tables, sorted within chunks of time, with no product of windows and stages.
    """
    none = F.lit(None).cast("struct<onset:double,stage:int>")
    left = windows.withColumns({"_t": F.col(time), "_kind": F.lit(1), "_s": none})
    right = stages.select("subject_id", F.col("onset_ts").alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col("onset_ts").alias("onset"), F.col("stage").cast("int").alias("stage")).alias("_s"))
    both = last_valid(left.unionByName(right, allowMissingColumns=True), ["subject_id"], ["_t", "_kind", "_s"], ["_s"])
    out = both.filter("_kind = 1").withColumn("stage", F.col("_s_last.stage")).withColumn("time_in_stage", F.col("_t") - F.col("_s_last.onset"))
    return out.drop("_t", "_kind", "_s", "_s_last")


def concat_sessions(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def loc_roc_intervals(loc: DataFrame, roc: DataFrame) -> DataFrame:
    """(subject_id, loc_ts, roc_ts, unconscious_s): the first recovery at or after each loss; null if none."""
    time = lambda c, kind: [F.col(c).alias("_t"), F.lit(kind).alias("_kind")]
    marks = loc.select("subject_id", *time("loc_ts", 0)).unionByName(roc.select("subject_id", *time("roc_ts", 1)))
    marks = marks.withColumn("_roc", F.when(F.col("_kind") == 1, F.col("_t")))
    out = last_valid(marks, ["subject_id"], ["_t", "_kind"], ["_roc"], False).filter("_kind = 0").select("subject_id", F.col("_t").alias("loc_ts"), F.col("_roc_last").alias("roc_ts"))
    return out.withColumn("unconscious_s", F.col("roc_ts") - F.col("loc_ts"))

