"""Sorted sweeps over a whole table without one task seeing it whole: range partitions, then totals carried over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt out by range of the order columns, with its partition number `pid`, written so that pid stays.

    Rows with equal keys may be split over neighbours, so a key that holds a third of the rows does no harm when
    a tie-break column ends the order. The carrying of state from one pid to the next is left to the caller.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[str], value: str | None, out: str, select: Sequence[str | Column] = ("*",)) -> DataFrame:
    """df with `out`, the sum of value (None: the count of rows) over all rows up to and with this one in the order.

    Ties are counted one by one in any order. Only one row for each partition goes through a single task. The result
    is a written table of the columns `select`, which may use `out`.
    """
    parts = ranged(df, order)
    one = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0)).cast("long")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("pid").agg(F.sum(one).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    )
    within = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = (
        parts.withColumn("_here", F.sum(one).over(within))
        .join(offsets.select("pid", "_before"), "pid")
        .withColumn(out, F.col("_here") + F.col("_before"))
        .drop("_here", "_before", "pid")
    )
    done = written(total.select(*select))
    discard(parts)
    return done
