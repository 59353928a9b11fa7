"""Column functions and row filters on samples: labels, bounds, motion, lookups, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import joined, running_sum
from ..operators.quantiles import exact_quantiles

# Label codes of the sample table.
LABEL_CODES = {"normal": 0, "pre_syncope": 1, "syncope": 2, "recovery": 3}
GRAVITY = 9.81


def encode_label(label: Column) -> Column:
    """Code of a label; unknown and null are 0."""
    out = F.lit(0)
    for name, code in LABEL_CODES.items():
        out = F.when(label == name, code).otherwise(out)
    return out.cast("int")


def clip(value: Column, lo: float, hi: float) -> Column:
    """value held within [lo, hi]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def accel_motion(df: DataFrame, x: str = "accel_x", y: str = "accel_y", z: str = "accel_z") -> DataFrame:
    """Adds accel_mag and accel_dyn, the part that isn't gravity; a missing axis counts as at rest (0, 0, g)."""
    a, b, c = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)), F.coalesce(z, F.lit(GRAVITY))
    mag = F.sqrt(a * a + b * b + c * c)
    return df.withColumn("accel_mag", mag).withColumn("accel_dyn", F.abs(F.col("accel_mag") - GRAVITY))


def interp_lookup(value: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear value of the curve (xs, ys), flat outside; xs ascending."""
    out = F.when(value <= xs[0], F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        out = out.when(value <= x1, F.lit(float(y0)) + (value - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.when(value.isNotNull(), F.lit(float(ys[-1])))


def validate_time(df: DataFrame, lo: float, hi: float, col: str = "timestamp") -> DataFrame:
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def flag_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds is_out_of_bounds by bounds (signal_name, lo, hi), a table of one row a signal; signals without bounds are within."""
    flagged = df.join(bounds, "signal_name", "left")
    return flagged.withColumn("is_out_of_bounds", F.coalesce(~F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False))).drop("lo", "hi")


def select_session(df: DataFrame, session_id: str) -> DataFrame:
    return df.filter(F.col("session_id") == session_id)


def event_sessions(df: DataFrame, event_log: DataFrame) -> DataFrame:
    """Rows of sessions that the event log names."""
    return df.join(event_log.select("session_id"), "session_id", "left_semi")


def window_id(subject: Column, start: Column) -> Column:
    """`subject_<id>_<start in ms>ms`."""
    return F.concat(F.lit("subject_"), subject.cast("string"), F.lit("_"), F.round(start * 1000).cast("bigint").cast("string"), F.lit("ms"))


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(cols), "signal_name", "value")


def center_on_median(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Adds <col>_centered, the deviation from the exact median of the keys, which may be of any size."""
    med = exact_quantiles(df, keys, col, {"_median": 0.5}).select(*keys, "_median")
    return joined(df, med, keys).withColumn(f"{col}_centered", F.col(col) - F.col("_median")).drop("_median")


def user_offsets(df: DataFrame, col: str) -> DataFrame:
    """(user_id, offset): mean of the user less the mean of all users' means."""
    own = df.groupBy("user_id").agg(F.avg(col).alias("m"))
    everyone = own.agg(F.avg("m").alias("all"))  # one row
    return own.crossJoin(F.broadcast(everyone)).select("user_id", (F.col("m") - F.col("all")).alias("offset"))


def beats(df: DataFrame, keys: Sequence[str], order: Sequence[str], rr: str = "rr", lo: float = 30.0, hi: float = 220.0) -> DataFrame:
    """Adds beat_time, the running sum of RR intervals (s), and hr = 60 / rr within [lo, hi]."""
    return running_sum(df, keys, order, F.col(rr), "beat_time").withColumn("hr", clip(60.0 / F.nullif(F.col(rr), F.lit(0.0)), lo, hi))
