"""Exact quantiles of keys of any size by distributed selection.

A key's values are counted into bins of equal width between its smallest and largest value; the bins that hold the wanted
ranks become the new ranges, and so on until a bin has one value or no more rows than a task may hold at once. Counts,
smallest and largest values are combined before every shuffle, so no buffer has more than `bins` bins or `most` values for
a key and rank, however many rows the key has. A key with few rows is done at once, as a plain group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .chunks import joined

BINS, MOST = 1024, 10_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, at: Mapping[str, float], bins: int = BINS, most: int = MOST) -> DataFrame:
    """(keys, n, lo, hi, one column for each name of `at`): the quantile at(name) in [0, 1] of col's values, on the line
    between the two nearest ranks.

    Nulls and NaN are left out; a key without values has null quantiles; null keys are a key. Infinite values are values:
    a quantile between two of different sign is NaN. Ties need no care, as equal values share all their bins.
    """
    value = F.col(col).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(value), value).alias("_v"))
    small = Window.partitionBy(*keys, "_b").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "spans")
    # the two ranks around each quantile, from 0
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array(*[x for q in at.values() for x in (F.floor(place(q)), F.ceil(place(q)))])
    # a goal is a rank within a bin; a bin is known by the number _b of values below it, and has _c values in [lo, hi]
    goals = spans.filter("n > 0").select(*keys, F.explode(F.array_distinct(ranks)).alias("_rank"), F.lit(0).cast("long").alias("_b"), F.col("n").alias("_c"), "lo", "hi")
    rows = joined(rows.filter("_v is not null"), spans.select(*keys, F.lit(0).cast("long").alias("_b"), F.col("n").alias("_c"), "lo", "hi"), keys)
    key = [*keys, "_b"]
    found: list[DataFrame] = []
    level = 0
    while True:
        goals = written(goals, "goals")
        found.append(goals.filter("lo = hi").select(*keys, "_rank", F.col("lo").alias("_x")))
        leaf = f"lo <> hi and _c <= {int(most)}"
        listed = rows.filter(leaf).groupBy(*key).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        nth = F.element_at("_all", (F.col("_rank") - F.col("_b") + 1).cast("int"))
        found.append(joined(goals.filter(leaf).select(*key, "_rank"), listed, key).select(*keys, "_rank", nth.alias("_x")))
        goals, rows = (x.filter(f"lo <> hi and _c > {int(most)}") for x in (goals, rows))
        if not goals.limit(1).count():
            break
        rows = rows.withColumn("_digit", _digit(bins, level % 2 == 1))
        counted = rows.groupBy(*key, "_digit").agg(F.count("*").alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counted = counted.withColumn("_from", F.col("_b") + F.coalesce(F.sum("_k").over(small), F.lit(0)))
        inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_k"))
        # each goal meets the bins of its own range, `bins` and two at most
        met = joined(goals.select(*key, "_rank"), counted, key).filter(inside)
        goals = written(met.select(*key, "_digit", "_rank", "_from", F.col("_k").alias("_c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")), "goals")
        next_bins = goals.drop("_rank").distinct()
        rows = joined(rows.select(*key, "_digit", "_v"), next_bins, [*key, "_digit"]).drop("_b", "_digit").withColumnRenamed("_from", "_b")
        goals = goals.drop("_b", "_digit").withColumnRenamed("_from", "_b")
        level += 1
    values = reduce(DataFrame.unionByName, found)
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    both = joined(spans, by_rank, keys, "left")
    return both.select(*keys, "n", "lo", "hi", *[_between(place(q)).alias(name) for name, q in at.items()])


def _digit(bins: int, by_magnitude: bool) -> Column:
    """Number of the bin of _v in [lo, hi], from 0; infinite values have the bins -1 and `bins` to themselves.

    It never falls as _v grows, which is all that counts. Bins are of equal width (halves keep that of a wide range
    finite) or, at every other level, of equal ratio, so that values of all magnitudes are told apart in a few levels.
    """
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    inf = F.lit(float("inf"))
    log = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746.0))  # noqa: E731  ln of the least double is -745
    image = log if by_magnitude else lambda x: x * 0.5
    share = (image(v) - image(lo)) / F.nullif(image(hi) - image(lo), F.lit(0.0))
    place = F.when((lo == -inf) | (hi == inf), log(v) / 3000.0 + 0.5).otherwise(F.coalesce(share, F.lit(0.0)))
    inner = F.least(F.floor(place * bins), F.lit(bins - 1))
    return F.when(v == -inf, -1).when(v == inf, bins).otherwise(inner).cast("long")


def _between(place: Column) -> Column:
    a, b = F.element_at("_at", F.floor(place)), F.element_at("_at", F.ceil(place))
    return F.when(F.floor(place) == F.ceil(place), a).otherwise(a + (b - a) * (place - F.floor(place)))
