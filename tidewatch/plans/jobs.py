"""Whole jobs of chained operators, from files to files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cleanse as C
from ..operators import features as X
from ..operators import labels as L
from ..operators import splits as P
from ..operators import windows as W
from ..operators.cleanse import rounded
from ..sources import io
from ..tables import written

KEYS = ["subject_id", "signal_name"]


@dataclass
class Derived:
    """Which signals the derived features look at: LF and HF power, skin conductance with its spike level, and the lag of
    the rate of change of LF, in whole seconds.
    """

    lf: str
    hf: str
    eda: str
    spike: float
    lag_s: int


def silver(bronze: DataFrame, order: Sequence[str], ffill: float, linear: float, longest: float, seconds: float) -> DataFrame:
    """Bronze rows without repeated keys, short gaps filled, long ones out."""
    known = C.dedup_latest(bronze, [*KEYS, *order], [])
    return C.drop_long_gaps(C.fill_gaps(known, KEYS, order, ffill, linear, seconds=seconds), longest)


def gold_of(rows: DataFrame, loc: DataFrame, signals: Sequence[str], size: int, stride: float, warn: float) -> DataFrame:
    """Silver rows to window statistics of z-scores side by side, time to the loss, label and temporal split."""
    z = C.normalize(rows, KEYS)[0].select(*KEYS, "timestamp", F.col("z").alias("value"))
    # places and splits read the windows more than once
    wide = written(X.pivot_features(X.sliding_stats(z, KEYS, size, stride), ["subject_id", "window_start"], signals), "wide")
    return P.temporal_split(L.label_windows(L.time_to_loc(wide, loc), warn))


def gold(bronze: DataFrame, loc: DataFrame, signals: Sequence[str], size: int, stride: float, warn: float, ffill: float, linear: float, longest: float, seconds: float) -> DataFrame:
    """Bronze signals to labelled features with splits. No table is collected; two runs over the same bronze rows give
    the same rows.
    """
    return gold_of(written(silver(bronze, ["timestamp", "event_id"], ffill, linear, longest, seconds), "silver"), loc, signals, size, stride, warn)


def derived_features(rows: DataFrame, derived: Derived, size: int, stride: float) -> DataFrame:
    """(subject_id, window_start, trend, LF / HF and trends, tonic level and change, spikes, mean rate of change) of
    silver rows, one for each window with a value.
    """
    values = rows.filter(F.col("value").isNotNull()).select(*KEYS, "timestamp", "value")
    by, length = ["subject_id", "window_start"], size * stride
    windows = W.time_windows(values, length, stride)
    only = lambda name: windows.filter(F.col("signal_name") == name)
    rate = X.rate_of_change(values.filter(F.col("signal_name") == derived.lf), ["subject_id"], derived.lag_s)
    rate = W.time_windows(rate, length, stride).groupBy(*by).agg(F.avg("roc").alias("roc"))
    parts = [X.autonomic(windows, by, derived.lf, derived.hf), X.trend(only(derived.lf), by, length), X.eda_reactivity(only(derived.eda), by, derived.spike), rate]
    out = reduce(lambda a, b: a.join(b, by, "left"), parts)
    return out.withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


def ingest(spark: SparkSession, signal_files: str, bronze: str, at: str) -> DataFrame:
    """Signal files into the bronze table, of which those rows are added that it lacks."""
    return io.append_bronze(io.with_ingest_meta(io.read_signals(spark, signal_files), at), bronze)


def files_to_gold(
    spark: SparkSession, signal_files: str, mark_files: str, bronze: str, out: str, signals: Sequence[str], derived: Derived, size: int, stride: float, warn: float,
    ffill: float, linear: float, longest: float, seconds: float, runs: int = 1, at: str = "2024-02-01", days: int = 90,
) -> DataFrame:
    """Per-subject signal and mark files to gold files, which are read back: ingest, retention, cleansing, statistics and
    derived features of windows, labels, splits, export with its parameters and summary.

    runs: how often the same files are ingested; each run after the first adds nothing.
    """
    for _ in range(runs):
        table = ingest(spark, signal_files, bronze, at)
    kept = io.retain(table, F.lit(at).cast("timestamp"), days)
    rows = written(silver(kept.select(*KEYS, "timestamp", "value"), ["timestamp"], ffill, linear, longest, seconds), "silver")
    # of several marks of a subject the last counts
    loc = io.read_marks(spark, mark_files, "loc_ts").groupBy("subject_id").agg(F.max("loc_ts").alias("loc_ts"))
    wide = gold_of(rows, loc, signals, size, stride, warn).join(written(derived_features(rows, derived, size, stride), "derived"), ["subject_id", "window_start"], "left")
    numbers = [c for c, t in wide.dtypes if t == "double" and c not in ("window_start", "loc_ts")]
    scaled = wide.withColumns({c: F.col(c) * 1000 for c in ("trend", "roc")})
    done = X.progress(scaled).withColumns({c: rounded(F.col(c)) for c in [*numbers, "progress"]})
    done = written(done.drop("has_loc", "loc_ts"), "gold")
    io.write_gold(done, out, {"params": C.normalize(rows, KEYS)[1], "summary": X.feature_stats(done, numbers)})
    return spark.read.schema(done.schema).option("header", True).csv(f"{out}/features").select(done.columns)


def class_table(rows: DataFrame, log: DataFrame, sparse: str, block: int, log_path: str, windows_path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(y, n, share, resampled, filled): samples labelled by the event log, a sparse channel resampled by blocks and back
    and also filled, windows by count with majority labels, both files written and read back, classes counted.
    """
    io.write_event_log(log, log_path)
    known = rows.sparkSession.read.schema(log.schema).option("header", True).csv(log_path)
    # each step reads its input more than once (chunks and what they carry), so steps are written
    labelled = written(L.label_phases(rows, known).withColumn("code", S.encode_label(F.col("label"))), "labelled")
    blocks = written(C.fill_blocks(written(C.resample_mean(labelled, keys, order, sparse, block), "blocks"), keys), "blocks")
    both = written(C.upsample_linear(labelled, blocks, keys, order, block).drop("rn").withColumn("resampled", rounded(F.col("resampled"))), "resampled")
    filled = written(C.fill_session(both, keys, [sparse], order), "filled")
    io.write_windows(W.labelled_windows(W.count_windows(filled, keys, order), keys, ["resampled", sparse], "code"), windows_path)
    total = lambda k: F.aggregate("x", F.lit(0.0), lambda a, r: a + r[k].cast("double"))
    g = io.read_windows(rows.sparkSession, windows_path).select("y", total(0).alias("a"), total(1).alias("b")).groupBy("y").agg(F.count("*").alias("n"), rounded(F.sum("a"), 2).alias("resampled"), rounded(F.sum("b"), 2).alias("filled"))
    whole = g.agg(F.sum("n").alias("_all"))  # one row
    return g.crossJoin(F.broadcast(whole)).select("y", "n", rounded(F.col("n") / F.col("_all")).alias("share"), "resampled", "filled")
