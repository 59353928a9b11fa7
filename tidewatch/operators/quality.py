"""Profiles and quality gates of the layers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles


def ingest_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_t"), F.max("timestamp").alias("last_t"))


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column, expected, found, n_missing, ok), one row for each column of either schema.

    A column is right if its type is the expected one and, where that doesn't allow nulls, no row has one: one pass. A
    column that the table lacks is missing in all rows.
    """
    have, want = ({f.name: f for f in s.fields} for s in (df.schema, expected))
    name = lambda fields, c: F.lit(fields[c].dataType.simpleString() if c in fields else None).cast("string")
    columns = list({**want, **have})
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns) if c in have], F.count("*").alias("_all"))
    rows = []
    for i, c in enumerate(columns):
        missing = F.col(f"n{i}" if c in have else "_all")
        right = c in have and c in want and have[c].dataType == want[c].dataType
        ok = F.lit(right) if not right or want[c].nullable else missing == 0
        rows.append(F.struct(F.lit(c).alias("column"), name(want, c).alias("expected"), name(have, c).alias("found"), missing.alias("n_missing"), ok.alias("ok")))
    return one.select(F.inline(F.array(*rows)))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, n_missing, lo, hi, duration_s, rate_hz)."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("timestamp") - F.min("timestamp")).alias("duration_s")
    )
    return g.withColumn("rate_hz", (F.col("n") - 1) / F.nullif(F.col("duration_s"), F.lit(0.0)))


# Highest shares that a layer may have.
SILVER_LIMITS = {"null_rate": 0.05, "outlier_rate": 0.02, "interpolated_rate": 0.10}


def silver_gates(df: DataFrame, keys: Sequence[str], limits: Mapping[str, float] = SILVER_LIMITS) -> DataFrame:
    """(keys, null_rate, outlier_rate, interpolated_rate, has_alert) from value, is_outlier, is_interpolated."""
    share = lambda c: F.avg(c.cast("int"))
    g = df.groupBy(*keys).agg(share(F.col("value").isNull()).alias("null_rate"), share(F.col("is_outlier")).alias("outlier_rate"), share(F.col("is_interpolated")).alias("interpolated_rate"))
    return g.withColumn("has_alert", reduce(lambda a, b: a | b, [F.col(c) > m for c, m in limits.items()]))


def check_normalized(df: DataFrame, keys: Sequence[str], tolerance: float = 1e-6, col: str = "z") -> DataFrame:
    """(keys, ok): mean 0 and deviation 1 (or 0 for a constant) within the tolerance."""
    g = df.groupBy(*keys).agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    return g.select(*keys, ((F.abs("m") <= tolerance) & ((F.abs(F.col("s") - 1) <= tolerance) | (F.col("s") <= tolerance))).alias("ok"))


def quality_score(gates: DataFrame) -> DataFrame:
    """Adds score: 1 less the three rates, at least 0."""
    return gates.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("null_rate") - F.col("outlier_rate") - F.col("interpolated_rate")))


def label_distribution(df: DataFrame, label: str = "label", classes: Sequence[object] = (0, 1, 2, 3)) -> DataFrame:
    """(label, n, percent) of every class, absent ones with 0; percent is null for an empty table."""
    one = df.agg(F.count("*").alias("all"), *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)]))
    return one.select("all", rows.alias("r")).select("r.label", "r.n", (100.0 * F.col("r.n") / F.nullif(F.col("all"), F.lit(0))).alias("percent"))


def label_gate(distribution: DataFrame, expected: Mapping[object, float], tolerance: float) -> DataFrame:
    """(label, percent, expected, ok) for the classes with an expected percentage."""
    want = F.lit(None).cast("double")
    for c, p in expected.items():
        want = F.when(F.col("label") == c, float(p)).otherwise(want)
    g = distribution.withColumn("expected", want).filter("expected is not null")
    return g.select("label", "percent", "expected", (F.abs(F.col("percent") - F.col("expected")) <= tolerance).alias("ok"))


def nan_gate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_bad, ok): nulls and NaN of each column, in one pass."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]
    return df.agg(*bad).unpivot([], list(cols), "feature", "n_bad").withColumn("ok", F.col("n_bad") == 0)


def window_counts(df: DataFrame, key: str = "subject_id", split: str = "split_set") -> DataFrame:
    """(subject, split, n, share of the subject's windows)."""
    g = df.groupBy(key, split).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def dataset_summary(df: DataFrame) -> DataFrame:
    """(activity, samples, sessions, users) of each activity and in all (activity null)."""
    return df.rollup("activity").agg(F.count("*").alias("samples"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("user_id").alias("users"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, means and products of deviations of a partition's rows, as one row."""
    n, mean, prod = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            m = x.mean(0)
            part = (len(x), m, (x - m).T @ (x - m))
            n, mean, prod = part if n == 0 else _merged((n, mean, prod), part)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([prod.tobytes()], pa.binary())], names=["n", "mean", "prod"])


def _merged(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _unpacked(n: int, mean: bytes, prod: bytes) -> tuple:
    m = np.frombuffer(mean, float)
    return n, m, np.frombuffer(prod, float).reshape(len(m), len(m))


def _merge_group(t: pa.Table) -> pa.Table:
    n, mean, prod = reduce(_merged, [_unpacked(*(x.as_py() for x in row)) for row in zip(t["n"], t["mean"], t["prod"], strict=True)])
    return pa.table({"at": t["to"].slice(0, 1), "n": [n], "mean": pa.array([mean.tobytes()], pa.binary()), "prod": pa.array([np.ascontiguousarray(prod).tobytes()], pa.binary())})


def correlation(df: DataFrame, cols: Sequence[str], fan: int = 32, levels: int = 3) -> DataFrame:
    """(a, b, r) of every pair over rows complete in all columns, rounded to 2; null where a column doesn't vary.

    Rows are read once: a partition gives one matrix of co-moments, `fan` neighbours are merged in a task, then `fan` of
    those, and so on; the driver merges what is left, one matrix for each fan^levels partitions. The matrix has a place
    for each pair of columns, whatever the number of rows.
    """
    spark = df.sparkSession
    whole = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    parts = whole.mapInArrow(_moments, "n bigint, mean binary, prod binary").withColumn("at", F.spark_partition_id().cast("long"))
    for _ in range(levels):
        parts = parts.withColumn("to", F.floor(F.col("at") / fan).cast("long")).groupBy("to").applyInArrow(_merge_group, "at bigint, n bigint, mean binary, prod binary")
    left = [_unpacked(r["n"], bytes(r["mean"]), bytes(r["prod"])) for r in parts.toLocalIterator()]
    found = reduce(_merged, left) if left else (0, None, np.zeros((len(cols), len(cols))))
    var = np.diag(found[2])
    with np.errstate(all="ignore"):
        r = found[2] / np.sqrt(np.outer(var, var))
    rows = [(a, b, None if not var[i] or not var[j] else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", F.round(F.col("r") + 1e-9, 2).alias("r"))


def box_stats(df: DataFrame, col: str, label: str = "label") -> DataFrame:
    """(label, lo, q1, median, q3, hi): exact, for labels with any number of rows."""
    q = exact_quantiles(df, [label], col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select(label, "lo", "q1", "median", "q3", "hi")


def gate_report(gates: Sequence[tuple[str, str, DataFrame, float]]) -> DataFrame:
    """(layer, gate, value, threshold, passed) of (layer, gate, one-row table with `value`, threshold): passed up to it."""
    rows = [df.select(F.lit(layer).alias("layer"), F.lit(gate).alias("gate"), F.col("value").cast("double").alias("value"), F.lit(float(limit)).alias("threshold")) for layer, gate, df, limit in gates]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("value") <= F.col("threshold"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows, with repeats, that only one of the tables has; both 0 for equal runs."""
    only = lambda x, y, side: x.exceptAll(y).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return only(a, b, "a").unionByName(only(b, a, "b"))
