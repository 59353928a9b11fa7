"""Running computations over long sessions without a session in one task.

A session is cut into chunks of time. Windows run inside (session, chunk); what a chunk needs from earlier ones - a
count, a sum, the last valid value, the row before - comes from one aggregated row for each chunk. Where a computation
needs some rows on either side, blocks of rows are given their margins as copies.

Null keys are a session of their own, and rows with a null time a chunk of their own, first in order: no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 86_400.0


def chunk_of(timestamp: Column, seconds: float = CHUNK_SECONDS) -> Column:
    return F.floor(timestamp / seconds).cast("long")


def joined(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the other columns of small, which has one row for each value of keys; null keys meet null keys."""
    right = small.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(right, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _chunked(df: DataFrame, time: str, seconds: float) -> DataFrame:
    return df.withColumn("_chunk", chunk_of(F.col(time), seconds))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, seconds: float = CHUNK_SECONDS, total: str | None = None) -> DataFrame:
    """Adds out: sum of value over the session's rows up to and with this one; total: a column for the sum over all.

    order[0] is the time in seconds.
    """
    df = _chunked(df, order[0], seconds).withColumn("_v", value)
    key = [*keys, "_chunk"]
    session = Window.partitionBy(*keys)
    before = session.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    past = df.groupBy(*key).agg(F.sum("_v").alias("_n")).withColumn("_past", F.sum("_n").over(before))
    past = (past.withColumn(total, F.sum("_n").over(session)) if total else past).drop("_n")
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = joined(df.withColumn("_here", F.sum("_v").over(within)), past, key)
    sums = F.when(F.col("_here").isNotNull() | F.col("_past").isNotNull(), F.coalesce("_here", F.lit(0)) + F.coalesce("_past", F.lit(0)))
    return both.withColumn(out, sums).drop("_v", "_chunk", "_here", "_past")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn", seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds out: number of the row in its session from 0, and n_rows, the session's number of rows."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, seconds, "n_rows").withColumn(out, F.col(out) - 1)


def last_valid(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], forward: bool = True, seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds <col>_last for each col: its last non-null value up to the row (forward) or the next from it (not forward)."""
    df = _chunked(df, order[0], seconds)
    key = [*keys, "_chunk"]
    by = [F.col(c) if forward else F.desc(c) for c in order]
    pick = F.max_by if forward else F.min_by
    far = F.struct(*order)
    ends = df.groupBy(*key).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), far)).alias(f"_e_{c}") for c in cols])
    chunks = Window.partitionBy(*keys).orderBy("_chunk" if forward else F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, *[F.last(f"_e_{c}", ignorenulls=True).over(chunks).alias(f"_p_{c}") for c in cols])
    within = Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = joined(df.select("*", *[F.last(c, ignorenulls=True).over(within).alias(f"_h_{c}") for c in cols]), ends, key)
    for c in cols:
        out = out.withColumn(f"{c}_last", F.coalesce(f"_h_{c}", f"_p_{c}")).drop(f"_h_{c}", f"_p_{c}")
    return out.drop("_chunk")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds before and after: structs of cols of the rows next to this one, null at the session's ends."""
    df = _chunked(df, order[0], seconds)
    key, row, at = [*keys, "_chunk"], F.struct(*cols), F.struct(*order)
    ends = df.groupBy(*key).agg(F.min_by(row, at).alias("_f"), F.max_by(row, at).alias("_l"))
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(*key, F.lag("_l").over(chunks).alias("_b"), F.lead("_f").over(chunks).alias("_a"))
    within = Window.partitionBy(*key).orderBy(*order)
    out = joined(df.withColumn("before", F.lag(row).over(within)).withColumn("after", F.lead(row).over(within)), ends, key)
    return out.withColumns({"before": F.coalesce("before", "_b"), "after": F.coalesce("after", "_a")}).drop("_chunk", "_a", "_b")


def with_margins(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, rows: int, seconds: float = CHUNK_SECONDS) -> DataFrame:
    """df in blocks of `rows` rows of a session, each with copies of the rows just before and after it.

    Adds rn, n_rows, block and own (false for the copies). rows must be at least before and after.
    """
    return margins_of(row_index(df, keys, order, seconds=seconds), before, after, rows)


def margins_of(numbered: DataFrame, before: int, after: int, rows: int) -> DataFrame:
    """with_margins for rows that have their rn and n_rows."""
    here = F.floor(F.col("rn") / rows).cast("long")
    low = F.greatest(F.lit(0), F.floor((F.col("rn") - after) / rows)).cast("long")
    high = F.least(F.floor((F.col("n_rows") - 1) / rows), F.floor((F.col("rn") + before) / rows)).cast("long")
    return numbered.withColumn("block", F.explode(F.sequence(low, high))).withColumn("own", F.col("block") == here)


def block_by_block(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt out by (keys, block), each block's rows one after another by rn: for maps over batches of many sessions."""
    return df.repartition(*[F.col(f"`{k}`") for k in keys], "block").sortWithinPartitions(*[F.col(f"`{k}`") for k in keys], "block", "rn")


def with_steps(df: DataFrame, low: str, high: str, out: str, keys: Sequence[str]) -> DataFrame:
    """df, one row for each value of keys, once for each whole number from low to high, in column out (long).

    First the chunks of 65,536 numbers, in turn by chunks of chunks, which are dealt out to all tasks; then the numbers
    inside a chunk. So no array has more than 65,536 entries up to 2^48 numbers, and no task makes a whole span's.
    """
    size = 1 << 16
    n = F.col(high) - F.col(low)  # numbers counted from low: 0 to n
    part = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long")))
    big = df.filter(F.col(high) >= F.col(low)).withColumn("_i", part(F.floor(n / (size * size))))
    inside = F.least(F.floor((n - F.col("_i") * (size * size)) / size), F.lit(size - 1))
    chunk = big.withColumn("_j", part(inside)).withColumn("_from", F.col("_i") * (size * size) + F.col("_j") * size)
    dealt = chunk.repartition(*[F.col(k) for k in keys], "_i", "_j")
    rows = dealt.withColumn("_s", part(F.least(n - F.col("_from"), F.lit(size - 1))))
    return rows.withColumn(out, F.col(low) + F.col("_from") + F.col("_s")).drop("_i", "_j", "_from", "_s")
