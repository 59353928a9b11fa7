"""Window statistics and derived features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import last_valid, with_margins

STATISTICS = ("mean", "std", "min", "max", "median", "p25", "p75")


def window_stats(windows: DataFrame, keys: Sequence[str], extra: bool = False) -> DataFrame:
    """(keys, n, the seven statistics of value); extra adds range and cv (null for mean 0)."""
    p = lambda q: F.percentile("value", F.lit(q))
    out = windows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"),
    )
    if extra:
        out = out.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))
    return out


def sliding_moments(df: DataFrame, keys: Sequence[str], size: int, stride: float, time: str = "timestamp") -> DataFrame:
    """(keys, window_start, n, mean, std, min, max) of windows of size strides, one starting at each stride >= 0.

    Rows are first summed up by stride bucket (count, mean, squared deviations, extremes); only buckets are then put in
    `size` windows and merged. Instead of size copies of every row, there are size copies of every bucket.
    """
    b = df.filter((F.col(time) >= 0) & F.col("value").isNotNull()).withColumn("_b", F.floor(F.col(time) / stride).cast("long"))
    b = b.groupBy(*keys, "_b").agg(
        F.count("value").alias("_n"), F.avg("value").alias("_m"), (F.var_pop("value") * F.count("value")).alias("_d"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    w = b.withColumn("_k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_b") - (size - 1)).cast("long"), F.col("_b"))))
    g = w.groupBy(*keys, "_k").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("_s"), F.collect_list(F.struct("_n", "_m", "_d")).alias("_parts"), F.min("_lo").alias("min"), F.max("_hi").alias("max")
    )
    mean = F.col("_s") / F.col("n")
    # within buckets plus between them; at most `size` parts in a window
    dev = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_d"] + p["_n"] * (p["_m"] - F.col("mean")) * (p["_m"] - F.col("mean")))
    g = g.withColumn("mean", mean).withColumn("std", F.sqrt(dev / F.col("n")))
    return g.select(*keys, (F.col("_k") * F.lit(float(stride))).alias("window_start"), "n", "mean", "std", "min", "max")


def sliding_stats(df: DataFrame, keys: Sequence[str], size: int, stride: float, time: str = "timestamp", extra: bool = False) -> DataFrame:
    """window_stats of windows of size strides, one starting at each stride >= 0, with window_start.

    The windows that start in one block of `size` strides need the values of that block and of the next one, so a value
    crosses the shuffle at most twice, however much windows overlap. A block's values are sorted once; each window takes
    its own from them in that order, and its order statistics are places in what it took.
    """
    v = df.filter((F.col(time) >= 0) & F.col("value").isNotNull()).select(*keys, F.floor(F.col(time) / stride).cast("long").alias("_b"), F.col("value").cast("double").alias("_v"))
    block = F.floor(F.col("_b") / size).cast("long")
    # own block, and the one before unless no window that starts there reaches the value
    reaches = (block > 0) & (F.col("_b") % size < size - 1)
    blocks = v.withColumn("_g", F.explode(F.when(reaches, F.array(block, block - 1)).otherwise(F.array(block))))
    g = blocks.groupBy(*keys, "_g").agg(F.sort_array(F.collect_list(F.struct("_v", "_b"))).alias("_all"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    first, last = F.greatest(F.col("_g") * size, F.col("_lo") - (size - 1)), F.least(F.col("_g") * size + (size - 1), F.col("_hi"))
    w = g.withColumn("_k", F.explode(F.sequence(first, last)))
    inside = F.filter("_all", lambda x: (x["_b"] >= F.col("_k")) & (x["_b"] < F.col("_k") + size))
    w = w.select(*keys, "_k", F.transform(inside, lambda x: x["_v"]).alias("_sorted")).withColumn("n", F.size("_sorted").cast("long")).filter("n > 0")
    total = lambda f: F.aggregate("_sorted", F.lit(0.0), f)
    w = w.withColumn("mean", total(lambda a, x: a + x) / F.col("n"))
    w = w.withColumn("std", F.sqrt(total(lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")))

    def at(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, c = F.element_at("_sorted", low + 1), F.element_at("_sorted", F.ceil(place).cast("int") + 1)
        return a + (c - a) * (place - low)

    values = {"min": F.element_at("_sorted", 1), "max": F.element_at("_sorted", -1), "median": at(0.5), "p25": at(0.25), "p75": at(0.75)}
    out = w.select(*keys, (F.col("_k") * F.lit(float(stride))).alias("window_start"), "n", "mean", "std", *[c.alias(k) for k, c in values.items()])
    if extra:
        out = out.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))
    return out


def pivot_features(stats: DataFrame, keys: Sequence[str], signals: Sequence[str], names: Sequence[str] = STATISTICS) -> DataFrame:
    """One row a window, one column <signal>_<statistic>; signals are given, so no job looks for them."""
    cols = [F.max(F.when(F.col("signal_name") == s, F.col(n))).alias(f"{s}_{n}") for s in signals for n in names]
    return stats.groupBy(*keys).agg(*cols)


def _time(windows: DataFrame, order: Sequence[str]) -> Column:
    """What orders a window's samples, null times first. One number is compared as it is: a struct would have every row
    sorted before rows are summed up.
    """
    if len(order) == 1 and windows.schema[order[0]].dataType == T.DoubleType():
        return F.coalesce(F.col(order[0]), F.lit(float("-inf")))
    return F.struct(*order)


def trend(windows: DataFrame, keys: Sequence[str], length: float, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """(keys, trend): last less first value of the window, by its length."""
    at = _time(windows, order)
    return windows.groupBy(*keys).agg(((F.max_by("value", at) - F.min_by("value", at)) / F.lit(float(length))).alias("trend"))


def rate_of_change(df: DataFrame, keys: Sequence[str], lag_s: int, time: str = "timestamp") -> DataFrame:
    """Adds roc: change by second since the last sample that is at least lag_s (whole seconds) old; null without one."""
    # each sample comes up once more when it is old enough; the last one to have come up by now is the one to compare with
    none = F.lit(None).cast(df.select(F.struct(F.col(time).alias("t"), F.col("value").alias("v")).alias("s")).schema["s"].dataType)
    now = df.withColumns({"_t": F.col(time), "_kind": F.lit(1), "_s": none})
    old = df.filter(F.col("value").isNotNull()).select(*keys, (F.col(time) + lag_s).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(time).alias("t"), F.col("value").alias("v")).alias("_s"))
    both = last_valid(now.unionByName(old, allowMissingColumns=True), keys, ["_t", "_kind", "_s"], ["_s"]).filter("_kind = 1")
    roc = (F.col("value") - F.col("_s_last.v")) / (F.col(time) - F.col("_s_last.t"))
    return both.withColumn("roc", roc).drop("_t", "_kind", "_s", "_s_last")


def autonomic(windows: DataFrame, keys: Sequence[str], lf: str = "lf", hf: str = "hf", order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """(keys, lf_hf, lf_hf_trend, lfnu_trend, hfnu_trend): mean LF over mean HF and changes from first to last sample."""
    at = _time(windows, order)
    first = lambda s: F.min_by(F.col("value"), F.when(F.col("signal_name") == s, at))
    last = lambda s: F.max_by(F.col("value"), F.when(F.col("signal_name") == s, at))
    mean = lambda s: F.avg(F.when(F.col("signal_name") == s, F.col("value")))
    g = windows.groupBy(*keys).agg(mean(lf).alias("_lf"), mean(hf).alias("_hf"), first(lf).alias("_lf0"), last(lf).alias("_lf1"), first(hf).alias("_hf0"), last(hf).alias("_hf1"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0.0))
    return g.select(
        *keys,
        ratio("_lf", "_hf").alias("lf_hf"),
        (ratio("_lf1", "_hf1") - ratio("_lf0", "_hf0")).alias("lf_hf_trend"),
        (share("_lf1", "_hf1") - share("_lf0", "_hf0")).alias("lfnu_trend"),
        (share("_hf1", "_lf1") - share("_hf0", "_lf0")).alias("hfnu_trend"),
    )


def eda_reactivity(windows: DataFrame, keys: Sequence[str], spike: float, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """(keys, tonic, tonic_change, n_spikes): mean level, last less first value, samples above `spike`."""
    at = _time(windows, order)
    return windows.groupBy(*keys).agg(
        F.avg("value").alias("tonic"), (F.max_by("value", at) - F.min_by("value", at)).alias("tonic_change"), F.count_if(F.col("value") > spike).alias("n_spikes")
    )


def progress(windows: DataFrame, time: str = "window_start") -> DataFrame:
    """Adds progress: how far the window lies in its subject's time line, in percent; null for a single instant."""
    span = windows.groupBy("subject_id").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return windows.join(span, "subject_id").withColumn("progress", 100.0 * (F.col(time) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).drop("_lo", "_hi")


def assemble(df: DataFrame, names: Sequence[str], out: str = "features", vector: bool = False) -> DataFrame:
    """Adds the features in the order of names, as an array of doubles or an ML vector."""
    values = F.array(*[F.col(c).cast("double") for c in names])
    return df.withColumn(out, array_to_vector(values) if vector else values)


def _bands(x: pd.Series, fs: pd.Series, edge: pd.Series) -> pd.DataFrame:
    """Windows of one length are transformed together; missing values are left out of a window first."""
    out = np.full((len(x), 3), np.nan)
    kept = [np.empty(0) if v is None else np.asarray(v, float)[np.isfinite(np.asarray(v, float))] for v in x]
    n = np.fromiter(map(len, kept), np.int64, len(kept))
    for length in np.unique(n[n > 1]):
        at = np.flatnonzero(n == length)
        v = np.stack([kept[i] for i in at])
        power = np.abs(np.fft.rfft(v - v.mean(1, keepdims=True), axis=1)) ** 2 / length
        f = np.fft.rfftfreq(length, 1 / fs.iloc[0])
        low = (f > 0) & (f < edge.iloc[0])
        out[at] = np.stack([power[:, low].sum(1), power[:, f >= edge.iloc[0]].sum(1), f[power.argmax(1)]], axis=1)
    return pd.DataFrame(out, columns=["low_power", "high_power", "dominant_hz"])


def _band_sums(power: np.ndarray, length: int, fs: float, edge: float) -> np.ndarray:
    f = np.fft.rfftfreq(length, 1 / fs)
    low = (f > 0) & (f < edge)
    return np.stack([power[:, low].sum(1), power[:, f >= edge].sum(1), f[power.argmax(1)]], axis=1)


def sliding_spectral(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, size: int, stride: int, fs: float, edge: float, rows: int = 100_000) -> DataFrame:
    """(keys, window_no, low_power, high_power, dominant_hz) of the count windows of col, as `spectral` of their arrays.

    Windows overlap, their transforms are not made anew: each stretch of `stride` rows gives its share of every bin once,
    turned to a common phase; the bins of a window are the difference of two running sums of shares, whose size is that of
    the window's transform. Windows with missing values, which are shorter, are transformed by themselves. A session is
    cut into blocks of about `rows` rows with the rows of the windows that reach over their ends. stride divides size.
    """
    if size % stride:
        raise ValueError("stride must divide size")
    blocks = with_margins(df.select(*keys, *order, F.col(col).cast("double").alias("_x")), keys, order, 0, size - 1, max(1, rows // size) * size)
    types = [df.schema[k] for k in keys]
    schema = T.StructType([*types, T.StructField("window_no", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("low_power", "high_power", "dominant_hz")]])
    parts = size // stride

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        v, first = pdf["_x"].to_numpy(float), int(pdf["rn"].iloc[0])
        whole = np.isfinite(v)
        starts = np.arange(0, int(pdf["own"].sum()), stride)
        starts = starts[(first + starts < int(pdf["n_rows"].iloc[0]) - size) & (starts + size <= len(v))]
        out = np.full((len(starts), 3), np.nan)
        if len(starts):
            x = np.where(whole, v, 0.0)
            x = x - x[whole].mean() if whole.any() else x  # a constant is in bin 0 only, which isn't looked at
            n = len(x) // stride
            k = np.arange(size // 2 + 1)
            wave = np.exp(-2j * np.pi * (np.arange(size) / size))
            share = x[: n * stride].reshape(n, stride) @ wave[np.outer(np.arange(stride), k) % size]
            total = np.concatenate([np.zeros((1, len(k))), np.cumsum(share * wave[np.outer(np.arange(n) * stride % size, k) % size], axis=0)])
            at = starts // stride
            power = np.abs(total[at + parts] - total[at]) ** 2 / size
            power[:, 0] = 0.0
            counted = lambda flag: np.concatenate([[0], np.cumsum(flag)])
            moves = counted(np.append(np.diff(x) != 0, False))
            power[moves[starts + size - 1] == moves[starts]] = 0.0
            out = _band_sums(power, size, fs, edge)
            holes = counted(~whole)
            for i in np.flatnonzero(holes[starts + size] > holes[starts]):
                kept = v[starts[i] : starts[i] + size]
                kept = kept[np.isfinite(kept)]
                out[i] = _band_sums(np.abs(np.fft.rfft(kept - kept.mean()))[None] ** 2 / len(kept), len(kept), fs, edge)[0] if len(kept) > 1 else np.nan
        done = pd.DataFrame(out, columns=["low_power", "high_power", "dominant_hz"])
        done.insert(0, "window_no", (first + starts) // stride)
        for j, key in enumerate(keys):
            done.insert(j, key, pdf[key].iloc[0])
        return done

    for key in keys:  # as count_windows
        blocks = blocks.filter(F.col(key).isNotNull())
    return blocks.groupBy(*keys, "block").applyInPandas(transform, schema)


def spectral(windows: DataFrame, fs: float, edge: float, values: str = "values") -> DataFrame:
    """Adds low_power (below edge Hz), high_power and dominant_hz of the array column `values`."""
    bands = F.pandas_udf(_bands, T.StructType([T.StructField(c, T.DoubleType()) for c in ("low_power", "high_power", "dominant_hz")]))
    s = bands(F.col(values), F.lit(float(fs)), F.lit(float(edge)))
    return windows.withColumn("_s", s).select("*", "_s.*").drop("_s")


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, min, max, mean, n_missing) in one pass."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.count_if(F.col(c).isNull()).alias("n_missing")).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols]))
    return one.select(rows.alias("r")).select("r.feature", "r.s.*")


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)

