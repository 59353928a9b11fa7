"""Windows over a session, by count and by time, their labels and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import joined, neighbours, row_index, running_sum, with_steps


def window_range(rn: Column, n: Column, size: int, stride: int) -> tuple[Column, Column]:
    """First and last number of the windows that hold row rn of n; window k starts at k * stride and exists iff
    k * stride < n - size, so the last window that fits exactly is left out.
    """
    lo = F.greatest(F.lit(0), F.ceil((rn - (size - 1)) / F.lit(float(stride))))
    hi = F.least(F.floor(rn / F.lit(float(stride))), F.ceil((n - size) / F.lit(float(stride))) - 1)
    return lo.cast("long"), hi.cast("long")


def count_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 128, stride: int = 32) -> DataFrame:
    """Each row once for each window it is in: adds window_no and rn. Rows with a null key are left out."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    rows = row_index(df, keys, order)
    lo, hi = window_range(F.col("rn"), F.col("n_rows"), size, stride)
    rows = rows.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo")
    return rows.withColumn("window_no", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "n_rows")


def majority_label(windows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, window_no, y): most frequent label code of the window, ties to the smallest."""
    votes = windows.groupBy(*keys, "window_no", label).agg(F.count("*").alias("_n"))
    return votes.groupBy(*keys, "window_no").agg(F.max(F.struct(F.col("_n"), (-F.col(label)).alias("l"))).alias("_top")).select(
        *keys, "window_no", (-F.col("_top.l")).cast("int").alias("y")
    )


def window_arrays(windows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, window_no, x): x is the window's rows in order, each an array of cols as floats."""
    row = F.struct("rn", F.array(*[F.col(c).cast("float") for c in cols]).alias("v"))
    return windows.groupBy(*keys, "window_no").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["v"]).alias("x"))


def labelled_windows(windows: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str = "label", user: str = "user_id") -> DataFrame:
    """(keys, user_id, window_no, y, x): arrays, majority label and the user of the window's first row, in one aggregate.

    The vote is over the window's own labels, at most its size: each label's first place in the sorted list of labels
    gives its count; the most frequent counts, ties to the smallest.
    """
    row = F.struct("rn", F.array(*[F.col(c).cast("float") for c in cols]).alias("v"), F.col(user).alias("u"), F.col(label).alias("l"))
    g = windows.groupBy(*keys, "window_no").agg(F.sort_array(F.collect_list(row)).alias("_w"))
    labels = F.transform("_w", lambda r: r["l"])
    votes = F.transform(F.array_distinct(labels), lambda l: F.struct(F.size(F.filter(labels, lambda x: x.eqNullSafe(l))).alias("n"), (-l).alias("l")))
    return g.select(*keys, F.col("_w")[0]["u"].alias("user_id"), "window_no", (-F.array_max(votes)["l"]).cast("int").alias("y"), F.transform("_w", lambda r: r["v"]).alias("x"))


def time_windows(df: DataFrame, size: float = 60.0, stride: float = 1.0, time: str = "timestamp") -> DataFrame:
    """Each row once for each half-open window [start, start + size) with start a multiple of stride: adds window_start."""
    lo = F.greatest(F.lit(0), F.floor((F.col(time) - size) / stride) + 1)
    hi = F.floor(F.col(time) / stride)
    rows = df.filter(F.col(time) >= 0).withColumn("_k", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return rows.withColumn("window_start", F.col("_k") * F.lit(float(stride))).drop("_k")


def valid_windows(windows: DataFrame, keys: Sequence[str], min_n: int, channels: Sequence[str], most_missing: float = 0.1) -> DataFrame:
    """(keys, n, is_valid): enough rows, every channel present, at most most_missing of the values missing."""
    seen = F.collect_set(F.when(F.col("value").isNotNull() & F.col("signal_name").isin(*channels), F.col("signal_name")))
    g = windows.groupBy(*keys).agg(F.count("*").alias("n"), F.size(seen).alias("_c"), F.avg(F.col("value").isNull().cast("int")).alias("_m"))
    return g.select(*keys, "n", ((F.col("n") >= min_n) & (F.col("_c") == len(channels)) & (F.col("_m") <= most_missing)).alias("is_valid"))


def phase_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, label, start, end, n) of each run of equal labels."""
    near = neighbours(df, keys, order, [label])
    changed = near.withColumn("_new", (F.col("before").isNull() | ~F.col(label).eqNullSafe(F.col(f"before.{label}"))).cast("long")).drop("before", "after")
    runs = running_sum(changed, keys, order, F.col("_new"), "_run")
    g = runs.groupBy(*keys, "_run", label).agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("n"))
    return g.drop("_run")


def horizon_label(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, length: int = 100, horizon: int = 20, stride: int = 1) -> DataFrame:
    """(keys, window_no, y): 1 if flag holds in one of the `horizon` rows after a window of `length` rows.

    Windows as in count_windows; their numbers are made chunk by chunk. A row flags the windows that end up to horizon
    rows before it, so nothing is sorted beyond numbering the rows.
    """
    rows = row_index(df, keys, order)
    n_windows = F.greatest(F.lit(0), F.ceil((F.col("n_rows") - length) / F.lit(float(stride)))).cast("long")
    spans = rows.filter("rn = 0").select(*keys, F.lit(0).cast("long").alias("_lo"), (n_windows - 1).alias("_hi"))
    all_w = with_steps(spans, "_lo", "_hi", "window_no", keys).select(*keys, "window_no")
    # row rn follows window k if k * stride + length <= rn < k * stride + length + horizon
    lo = F.greatest(F.lit(0), F.floor((F.col("rn") - length - horizon) / F.lit(float(stride))) + 1).cast("long")
    hi = F.least(F.floor((F.col("rn") - length) / F.lit(float(stride))), n_windows - 1).cast("long")
    hit = rows.filter(flag).withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo")
    hit = hit.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("window_no")).distinct().withColumn("_y", F.lit(1))
    return joined(all_w, hit, [*keys, "window_no"], "left").select(*keys, "window_no", F.coalesce("_y", F.lit(0)).alias("y"))
