"""Cleansing of signals: duplicates, gaps, fills, interpolation, outliers, resampling, normalisation, smoothing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .chunks import CHUNK_SECONDS, block_by_block, joined, last_valid, margins_of, neighbours, row_index, running_sum, with_margins, with_steps
from .quantiles import exact_quantiles

#: Rows of a session that one task works on.
BLOCK_ROWS = 100_000


def dedup_latest(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `latest`: an aggregate with map-side combine, not a sort."""
    rest = [c for c in df.columns if c not in keys and c not in latest]
    top = df.groupBy(*keys).agg(F.max(F.struct(*latest, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (*latest, *rest)]).select(df.columns)


def gaps(df: DataFrame, keys: Sequence[str] = ("subject_id", "signal_name"), order: Sequence[str] = ("timestamp",), seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds gap_before and gap_after, seconds to the neighbouring samples of the key."""
    t = order[0]
    near = neighbours(df, keys, order, [t], seconds)
    return near.withColumns({"gap_before": F.col(t) - F.col(f"before.{t}"), "gap_after": F.col(f"after.{t}") - F.col(t)}).drop("before", "after")


def _neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: float) -> DataFrame:
    """Adds _prev and _next, structs (t, v) of the nearest valid samples on either side, the row's own included."""
    valid = F.when(F.col("value").isNotNull(), F.struct(F.col(order[0]).alias("t"), F.col("value").alias("v")))
    df = last_valid(df.withColumn("_pt", valid), keys, order, ["_pt"], True, seconds).withColumnRenamed("_pt_last", "_prev")
    return last_valid(df, keys, order, ["_pt"], False, seconds).withColumnRenamed("_pt_last", "_next").drop("_pt")


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str] = ("subject_id", "signal_name"),
    order: Sequence[str] = ("timestamp",),
    ffill_below: float = 2.0,
    linear_below: float = 5.0,
    seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Fills missing values by the gap between the valid neighbours: under ffill_below with the value before, under
    linear_below on the line between them, else not. Adds value_raw, is_interpolated, interpolation_gap_seconds.
    """
    near = _neighbours(df, keys, order, seconds)
    gap = F.col("_next.t") - F.col("_prev.t")
    missing = F.col("value").isNull()
    share = (F.col(order[0]) - F.col("_prev.t")) / F.nullif(gap, F.lit(0.0))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    filled = F.when(missing & (gap < ffill_below), F.col("_prev.v")).when(missing & (gap < linear_below), line)
    return (
        near.withColumn("value_raw", F.col("value"))
        .withColumn("interpolation_gap_seconds", F.when(missing, gap))
        .withColumn("_f", filled)
        .withColumn("is_interpolated", F.col("_f").isNotNull())
        .withColumn("value", F.coalesce("value", "_f"))
        .drop("_prev", "_next", "_f")
    )


def fill_short(df: DataFrame, max_gap: float = 2.0, **how: object) -> DataFrame:
    """Forward fill of gaps under max_gap only."""
    return fill_gaps(df, ffill_below=max_gap, linear_below=0.0, **how)


def interpolate(df: DataFrame, max_gap: float = 5.0, **how: object) -> DataFrame:
    """Linear interpolation of gaps under max_gap only."""
    return fill_gaps(df, ffill_below=0.0, linear_below=max_gap, **how)


def drop_long_gaps(df: DataFrame, longest: float = 60.0, flag_from: float = 5.0) -> DataFrame:
    """Leaves out missing rows of gaps over `longest`; adds is_long_gap for those from flag_from on. After fill_gaps."""
    gap = F.col("interpolation_gap_seconds")
    return df.filter(gap.isNull() | (gap <= longest) | F.col("value").isNotNull()).withColumn("is_long_gap", F.coalesce(gap >= flag_from, F.lit(False)))


def missing_policy(df: DataFrame, rules: DataFrame, window_keys: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Treats each signal's missing values by rules (signal_name, policy, limit), one row a signal:

    linear / ffill: fill where the gap is under limit; drop_window: leave out windows with more than limit missing.
    """
    near = _neighbours(df.join(rules, "signal_name", "left"), keys, order, CHUNK_SECONDS)
    gap = F.col("_next.t") - F.col("_prev.t")
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (F.col(order[0]) - F.col("_prev.t")) / F.nullif(gap, F.lit(0.0))
    missing = F.col("value").isNull()
    filled = F.when(missing & (F.col("policy") == "linear") & (gap < F.col("limit")), line)
    filled = filled.when(missing & (F.col("policy") == "ffill") & (gap < F.col("limit")), F.col("_prev.v"))
    share = df.groupBy(*window_keys).agg(F.avg(F.col("value").isNull().cast("int")).alias("_share"))
    kept = joined(near.withColumn("value", F.coalesce("value", filled)), share, window_keys)
    return kept.filter(~((F.coalesce("policy", F.lit("")) == "drop_window") & (F.col("_share") > F.col("limit")))).drop("_prev", "_next", "_share", "policy", "limit")


def flag_iqr(df: DataFrame, keys: Sequence[str], k: float = 3.0, lower: bool = False) -> DataFrame:
    """Adds is_outlier: above Q3 + k IQR of the key (lower: or below Q1 - k IQR), by exact quartiles of keys of any size."""
    q = exact_quantiles(df, keys, "value", {"_q1": 0.25, "_q3": 0.75}).select(*keys, "_q1", "_q3")
    span = (F.col("_q3") - F.col("_q1")) * k
    out = F.col("value") > F.col("_q3") + span
    if lower:
        out = out | (F.col("value") < F.col("_q1") - span)
    return joined(df, q, keys).withColumn("is_outlier", F.coalesce(out, F.lit(False))).drop("_q1", "_q3")


def fill_session(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str], seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Forward, then backward fill over the whole session."""
    out = last_valid(df, keys, order, cols, True, seconds)
    for c in cols:
        out = out.withColumnRenamed(f"{c}_last", f"_f_{c}")
    out = last_valid(out, keys, order, cols, False, seconds)
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_f_{c}", f"{c}_last")).drop(f"_f_{c}", f"{c}_last")
    return out.select(df.columns)


def resample_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, block: int) -> DataFrame:
    """(keys, block, value): mean of each full block of rows, nulls skipped; an incomplete last block is left out."""
    rows = row_index(df, keys, order).withColumn("block", F.floor(F.col("rn") / block).cast("long"))
    return rows.filter((F.col("block") + 1) * block <= F.col("n_rows")).groupBy(*keys, "block").agg(F.avg(col).alias("value"))


def fill_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks without a value get the one before, leading ones the first valid one."""
    return fill_session(blocks, keys, ["value"], ["block"])


def upsample_linear(df: DataFrame, blocks: DataFrame, keys: Sequence[str], order: Sequence[str], block: int, out: str = "resampled") -> DataFrame:
    """Adds out: block values at block centres (row block // 2), joined by lines; the last value also holds at the last
    row; rows before the first centre have the first value. blocks: (keys, block, value). Sessions without a full block
    stay, with nulls.
    """
    near = neighbours(blocks.withColumn("_at", F.col("block").cast("double")), keys, ["_at"], ["value"])
    first = blocks.groupBy(*keys).agg(F.min_by("value", "block").alias("_first"), F.max("block").alias("_lastb"))
    anchors = near.select(*keys, "block", F.col("value").alias("_v"), F.col("after.value").alias("_next"))
    rows = joined(row_index(df, keys, order), first, keys, "left")
    half = block // 2
    at = F.floor((F.col("rn") - half) / block)
    rows = rows.withColumn("block", F.least(F.greatest(at, F.lit(0)), F.col("_lastb")).cast("long"))
    both = joined(rows, anchors, [*keys, "block"], "left")
    share = (F.col("rn") - half - F.col("block") * block) / F.lit(float(block))
    value = F.when(F.col("rn") < half, F.col("_first")).when(F.col("_next").isNull(), F.col("_v")).otherwise(F.col("_v") + (F.col("_next") - F.col("_v")) * share)
    return both.withColumn(out, F.when(F.col("_lastb").isNotNull(), value)).select(*df.columns, "rn", out)


def regular_grid(df: DataFrame, keys: Sequence[str], step: float, col: str = "timestamp", longest: float | None = None) -> DataFrame:
    """One row for each step from the key's first to its last instant; instants without a sample have nulls.

    Instants are counted in whole steps, so no sum of fractions drifts; samples without a time are left out. longest: a
    stretch of more than so many seconds without samples stays empty, so a stray time far from all others is a row and not
    a million; `grid_breaks` reports such stretches. Steps are made chunk by chunk (chunks.with_steps), by many tasks.
    """
    n = df.filter(F.col(col).isNotNull()).withColumn("_k", F.round(F.col(col) / step).cast("long"))
    rest = [c for c in df.columns if c not in keys and c != col]
    by = [*keys, "_run"]
    n = n.withColumn("_run", F.lit(0).cast("long")) if longest is None else _grid_runs(n, keys, longest / step)
    span = n.groupBy(*by).agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    grid = with_steps(span, "_lo", "_hi", "_k", by).select(*keys, "_k")
    same = reduce(lambda a, b: a & b, [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, "_k"]])
    met = grid.alias("g").join(n.select(*keys, "_k", *rest).alias("s"), same, "left")
    return met.select(*[F.col(f"g.{k}").alias(k) for k in keys], *[F.col(f"s.{c}").alias(c) for c in rest], (F.col("g._k") * step).alias(col))


def _grid_runs(n: DataFrame, keys: Sequence[str], most: float) -> DataFrame:
    """Adds _run, which grows where a key's instants _k lie more than `most` steps apart."""
    near = neighbours(n.withColumn("_at", F.col("_k").cast("double")), keys, ["_at"], ["_k"])
    new = (F.col("_k") - F.col("before._k") > F.lit(float(most))).cast("long")
    fresh = near.withColumn("_new", F.coalesce(new, F.lit(0))).drop("before", "after")
    return running_sum(fresh, keys, ["_at"], F.col("_new"), "_run").drop("_new", "_at")


def grid_breaks(df: DataFrame, keys: Sequence[str], longest: float, col: str = "timestamp") -> DataFrame:
    """(keys, start, end) of each stretch of more than `longest` seconds between neighbouring samples."""
    near = gaps(df.filter(F.col(col).isNotNull()).select(*keys, col), keys, [col])
    return near.filter(F.col("gap_after") > longest).select(*keys, F.col(col).alias("start"), (F.col(col) + F.col("gap_after")).alias("end"))


def normalize(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df with z, parameters): z by mean and population deviation of the key, a zero deviation counting as 1."""
    params = df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return apply_params(df, params, keys), params


def apply_params(df: DataFrame, params: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Adds z by params (keys, mean, std). how: left, null for keys without parameters, or inner, without their rows."""
    scale = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return joined(df, params, keys, how).withColumn("z", (F.col("value") - F.col("mean")) / scale).drop("mean", "std")


def null_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str) -> DataFrame:
    """(keys, start, end, length) of each run of missing values; start and end are times."""
    valid = running_sum(df, keys, order, F.col(col).isNotNull().cast("long"), "_run")
    runs = valid.filter(F.col(col).isNull()).groupBy(*keys, "_run")
    return runs.agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("length")).drop("_run")


def flag_spikes(df: DataFrame, keys: Sequence[str], col: str, k: float = 5.0) -> DataFrame:
    """Adds is_spike: more than k population deviations from the mean of the key."""
    s = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return joined(df, s, keys).withColumn("is_spike", F.coalesce(F.abs(F.col(col) - F.col("_m")) > k * F.col("_s"), F.lit(False))).drop("_m", "_s")


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, k: int, out: str = "smooth", rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred mean over k rows with zeros beyond the edges: always divided by k."""
    blocks = with_margins(df, keys, order, k // 2, (k - 1) // 2, max(rows, k))
    w = Window.partitionBy(*keys, "block").orderBy("rn").rowsBetween(-(k // 2), (k - 1) // 2)
    return blocks.withColumn(out, F.sum(col).over(w) / F.lit(float(k))).filter("own").select(*df.columns, out)


def drift(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str = "drift") -> DataFrame:
    """Running sum of col."""
    return running_sum(df, keys, order, F.col(col), out)


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, tau: float, fs: float, out: str = "ema", rows: int = BLOCK_ROWS) -> DataFrame:
    """First-order lag: y += a (x - y) with a = 1 - exp(-1 / (tau fs)), from the first value on; a missing x holds y.

    y is linear in the value before: blocks of rows are smoothed as if nothing came before, and the value at the end of
    one block, times (1 - a) to the number of values since, is added to the next ones. Blocks of many sessions go through
    one map over batches, so short sessions cost no call each; only sessions of several blocks meet what came before.
    The smoothed blocks are written.
    """
    a = float(1 - np.exp(-1 / (tau * fs)))
    value = F.when(~F.isnan(F.col(col)), F.col(col).cast("double"))
    numbered = row_index(df, keys, order).withColumn("block", F.floor(F.col("rn") / rows).cast("long")).withColumn("_x", value)
    schema = T.StructType([*numbered.schema.fields, T.StructField("_local", T.DoubleType()), T.StructField("_n", T.LongType())])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = 0.0, 0  # of the block that goes on from the batch before
        for b in batches:
            if not b.num_rows:
                continue
            rn, block, x = (b[c].to_numpy(zero_copy_only=False) for c in ("rn", "block", "_x"))
            known, fresh = ~np.isnan(x.astype(float)), rn == block * rows
            part, total = np.cumsum(fresh), np.cumsum(known)
            n = total - np.append(-count, (total - known)[fresh])[part]
            # a session's first value counts whole, later ones with weight a; if block 0 has none, see below
            y = np.where((block == 0) & (n == 1), x, a * x)[known]
            of = part[known]
            if len(y) and of[0] == 0:
                y[0] += (1 - a) * last
            step = 1
            while step < np.bincount(of, minlength=1).max():  # sums over twice as many values of a block each time
                y[step:] = y[step:] + np.where(of[step:] == of[:-step], (1 - a) ** step * y[:-step], 0.0)
                step *= 2
            local = np.where(n > 0, np.append(last, y)[total], 0.0)
            last, count = local[-1], n[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local), pa.array(n)], names=[*b.schema.names, "_local", "_n"])

    local = written(block_by_block(numbered, keys).mapInArrow(smooth, schema), "smoothed")
    one, many = (local.filter(c) for c in (F.col("n_rows") <= rows, F.col("n_rows") > rows))
    first = F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("rn")))
    ends = many.groupBy(*keys, "block").agg(F.max_by("_local", "rn").alias("_e"), F.max("_n").alias("_m"), first.alias("_f"))
    # one row a block: its end without and with what came before; before any value, a block's first value
    listed = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "_e", "_m", "_f"))).alias("_ends"))
    into = lambda s, e: F.when(e["block"] == 0, 0.0).otherwise(F.coalesce(s["y"], e["_f"]))
    carried = F.aggregate(
        "_ends",
        F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<block:bigint,y:double,known:boolean>>").alias("out")),
        lambda s, e: F.struct(
            F.when((e["block"] > 0) | (e["_m"] > 0), e["_e"] + into(s, e) * F.pow(F.lit(1 - a), e["_m"])).alias("y"),
            F.concat(s["out"], F.array(F.struct(e["block"].alias("block"), into(s, e).alias("y"), s["y"].isNotNull().alias("known")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    past = listed.select(*keys, F.explode(carried).alias("_c")).select(*keys, "_c.block", F.col("_c.y").alias("_into"), F.col("_c.known").alias("_known"))
    y = F.col("_local") + F.col("_into") * F.pow(F.lit(1 - a), F.col("_n"))
    later = joined(many, past, [*keys, "block"]).withColumn(out, F.when(F.col("_known") | (F.col("_n") > 0), y))
    return one.withColumn(out, F.when(F.col("_n") > 0, F.col("_local"))).select(*df.columns, out).unionByName(later.select(*df.columns, out))


def lowpass(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, fc: float, fs: float, n: int = 4, out: str = "lowpass", rows: int = BLOCK_ROWS) -> DataFrame:
    """Zero-phase low-pass with the gain of a Butterworth filter run forth and back, by FFT of the reflected session.

    Missing values are taken from the line between their neighbours, by row. Edges differ from a padded recursive filter.
    Blocks of rows are filtered with margins of 12 fs / fc rows on either side, beyond which the filter's response is
    below 1e-9; only the session's own ends are reflected. Blocks of many sessions go through one map over batches; the
    nearest values outside a block's margins come from one aggregated row for each block, of sessions of several blocks
    only. The numbered rows are written.
    """
    margin = int(np.ceil(12 * fs / fc))
    rows = max(rows, margin)
    value = F.when(~F.isnan(F.col(col)), F.col(col).cast("double"))
    numbered = written(row_index(df, keys, order).withColumn("_x", value), "numbered")
    one, many = (numbered.filter(c) for c in (F.col("n_rows") <= rows, F.col("n_rows") > rows))
    none = F.lit(None).cast("struct<t:bigint,v:double>")
    one = one.withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True), "_p": none, "_q": none})
    blocks = one.unionByName(joined(margins_of(many, margin, margin, rows), _outside(many, keys, margin, rows), [*keys, "block"]))
    blocks = blocks.withColumns({f"_{e}{c}": F.col(f"_{e}.{c}") for e in "pq" for c in "tv"}).drop("_p", "_q")
    schema = T.StructType([*blocks.schema.fields, T.StructField(out, T.DoubleType())])

    def filtered(x: np.ndarray, rn: np.ndarray, n_rows: int, near: list[tuple[float, float]]) -> np.ndarray:
        known = ~np.isnan(x)
        if not known.all():
            before, after = ([(t, v)] if v == v else [] for t, v in near)
            points = np.array([*before, *zip(rn[known], x[known], strict=True), *after], float).reshape(-1, 2)
            x = np.where(known, x, np.interp(rn, points[:, 0], points[:, 1])) if len(points) else x
        if len(x) < 2 or not np.isfinite(x).all():
            return x
        left = min(len(x) - 1, 2 * margin) if rn[0] == 0 else 0
        right = min(len(x) - 1, 2 * margin) if rn[-1] == n_rows - 1 else 0
        whole = np.concatenate([2 * x[0] - x[left:0:-1], x, 2 * x[-1] - x[-2 : -2 - right : -1]])
        # a mirror image after it, so that the ends of the transform meet
        whole = np.concatenate([whole, whole[::-1]])
        f = np.fft.rfftfreq(len(whole), 1 / fs)
        gain = 1 / (1 + (np.tan(np.pi * np.minimum(f, fs / 2 - 1e-9) / fs) / np.tan(np.pi * fc / fs)) ** (2 * n))
        return np.fft.irfft(np.fft.rfft(whole) * gain, len(whole))[left : left + len(x)]

    def begins(b: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.flatnonzero(b["rn"].to_numpy() == np.maximum(0, b["block"].to_numpy() * rows - margin))

    def whole_blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        x, rn, n_rows, pt, pv, qt, qv = (t[c].to_numpy() for c in ("_x", "rn", "n_rows", "_pt", "_pv", "_qt", "_qv"))
        x, pv, qv = (v.astype(float) for v in (x, pv, qv))
        at = [*begins(t).tolist(), t.num_rows]
        y = np.concatenate([filtered(x[i:j], rn[i:j], n_rows[i], [(pt[i], pv[i]), (qt[i], qv[i])]) for i, j in zip(at[:-1], at[1:], strict=True)])
        yield from t.append_column(out, pa.array(y, from_pandas=True)).to_batches()

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            # what lies before the last block that begins here is whole
            at = int(begins(b)[-1]) if len(begins(b)) else 0
            if at or (held and len(begins(b))):
                yield from whole_blocks([*held, b.slice(0, at)])
                held = []
            held.append(b.slice(at))
        if sum(b.num_rows for b in held):
            yield from whole_blocks(held)

    return block_by_block(blocks, keys).mapInArrow(smooth, schema).filter("own").select(*df.columns, out)


def _outside(numbered: DataFrame, keys: Sequence[str], margin: int, rows: int) -> DataFrame:
    """(keys, block, _p, _q): the last value (t: rn, v: _x) before a block's margins and the first one after them."""
    known, point = F.col("_x").isNotNull(), F.struct(F.col("rn").alias("t"), F.col("_x").alias("v"))
    if_at = lambda c: F.when(known & c, F.col("rn"))
    ends = numbered.withColumn("block", F.floor(F.col("rn") / rows).cast("long")).groupBy(*keys, "block").agg(
        F.max_by(point, if_at(F.col("rn") < (F.col("block") + 1) * rows - margin)).alias("_before"),
        F.min_by(point, if_at(F.col("rn") >= F.col("block") * rows + margin)).alias("_after"),
        F.min_by(point, if_at(F.lit(True))).alias("_first"),
        F.max_by(point, if_at(F.lit(True))).alias("_last"),
    )
    # the neighbouring block is cut by the margin; those beyond it are whole
    up, down = Window.partitionBy(*keys).orderBy("block"), Window.partitionBy(*keys).orderBy(F.desc("block"))
    far = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -2))
    before, after = F.coalesce(F.lag("_before").over(up), far("_last", up)), F.coalesce(F.lag("_after").over(down), far("_first", down))
    return ends.select(*keys, "block", before.alias("_p"), after.alias("_q"))


POLICIES: Mapping[str, tuple[str, float]] = {"heart_rate": ("linear", 5.0), "eda": ("ffill", 5.0), "lf_hf": ("drop_window", 0.1)}


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounded away from binary ties, so that engines agree on means that end in 5."""
    return F.round(value + 1e-9, digits)
