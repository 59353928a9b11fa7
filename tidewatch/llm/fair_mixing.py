"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source gets a target of words. Its documents queue in a shuffled order, once for each allowed pass, and each
copy gets a virtual finish time: the words queued in the source up to and with it, divided by the source's target.
All copies are range-sorted by finish time and taken until the total budget is spent, so every source has come about
as far along its target as any other when the budget ends.

The queue of a source that holds most rows is never in one task: running totals are taken within slices of the
shuffled order and carried over. The shuffle is a hash of the row and a seed, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows of size 0 are taken
0 times; repeated rows count one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .sweep import ranged, running_total

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 2
SLICE_ROWS = 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, have the weights in turn and share `share` x all sizes; a target stops at
    passes x its source's size and the excess is shared anew by weight among the others until none is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * float(passes)).alias("cap")
    totals = running_total(totals, ["_last", "source"], None, "_nth", ["source", "source_size", w.alias("w"), cap])
    budget = float(share * (totals.agg(F.sum("source_size")).first()[0] or 0))
    rate, seen = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(rate)
        n, capped, open_w = totals.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))
        ).first()
        if n == seen or not open_w:
            break
        seen, rate = n, (budget - capped) / open_w
    return totals.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(rate)).alias("target"))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = PASSES, seed: int = 17) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) for each row of df (doc_id, source, text).

    target: that of the row's source; taken: the words that the mix takes of the row, all passes counted. Texts are read
    once; what is sorted and written to the shared folder are ids, sizes and hashes.
    """
    rows = df.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    rows = written(rows)
    mixed = _queued(rows, weights, share, passes)
    discard(rows)
    return mixed.select("doc_id", "source", "text_hash", "size", "source_size", "target", "taken")


def _queued(sized: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """sized (doc_id, source, size, _h) with source_size, target, taken."""
    targets = written(source_targets(sized.select("source", "size"), weights, share, passes))
    # a slice of one source has about SLICE_ROWS rows at most, however large the source is, and all tasks get slices
    slices = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // SLICE_ROWS))
    sized = sized.withColumn("_slice", F.pmod(F.col("_h"), F.lit(slices)))
    # running words of each source: within slices of its shuffled order, then what earlier slices hold
    key = ["source", "_slice"]
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    past = (
        sized.groupBy(*key)
        .agg(F.sum("size").alias("_n"))
        .withColumn("_past", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
        .select("_s", F.col("_slice").alias("_k"), "_past", "source_size", "target")
    )
    order = ["_h", "doc_id", "size"]
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("_here", F.sum("size").over(within))
    queued = queued.join(past, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k"))).drop("_s", "_k")
    queued = written(queued.withColumn("_upto", F.col("_past") + F.col("_here")))
    cutoff = _cutoff(queued, passes, targets.agg(F.sum("target")).first()[0] or 0.0)
    discard(targets)
    taken = F.lit(0).cast("long")
    for k in range(passes):
        finish = _finish(F.lit(k))
        if cutoff is not None:
            inside = finish < F.lit(cutoff["f"])
            tie = (finish == F.lit(cutoff["f"])) & (F.struct(F.lit(k).alias("k"), "_h").__le__(F.struct(F.lit(cutoff["k"]).alias("k"), F.lit(cutoff["h"]).alias("_h"))))
            taken = taken + F.when(inside | tie, F.col("size")).otherwise(0)
    return queued.withColumn("taken", taken.cast("long"))


def _finish(k: Column) -> Column:
    """Virtual finish time of the copy of pass k; 0 where a source has no target, as it then has no words."""
    return F.coalesce((F.col("_upto") + k * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))


def _cutoff(queued: DataFrame, passes: int, budget: float) -> dict | None:
    """The last copy in the global order of finish times with which the words taken stay within the sum of targets."""
    # a source without words has no copies to queue
    copies = queued.filter("size > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.select(_finish(F.col("k")).alias("f"), "k", F.col("_h").alias("h"), "size")
    order = ["f", "k", "h"]
    parts = ranged(copies, order)
    sums = parts.groupBy("pid").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("pid")))
    # the part in which the budget ends, and the words before it
    last = sums.filter(F.col("upto") - F.col("n") <= F.lit(budget)).orderBy(F.desc("pid")).first()
    if last is None:
        discard(parts)
        return None
    running = F.sum("size").over(Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fits = parts.filter(F.col("pid") == last["pid"]).withColumn("sum", running + F.lit(last["upto"] - last["n"])).filter(F.col("sum") <= F.lit(budget))
    found = fits.orderBy(*[F.desc(c) for c in order]).first() or parts.filter(F.col("pid") < last["pid"]).orderBy(*[F.desc(c) for c in order]).first()
    discard(parts)
    return found and found.asDict()
