"""Folds, temporal splits, standardisation without leakage, class weights, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import joined, row_index


def temporal_split(df: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2), key: str = "subject_id", order: Sequence[str] = ("window_start",)) -> DataFrame:
    """Adds split_set: train, val, test by place in the subject's own time. order[0] is the time in seconds."""
    numbered = row_index(df, [key], order, "_rn")
    share = F.col("_rn") / F.col("n_rows")
    # an edge at 0.6 + 0.2 is 0.8, whatever the sum of the doubles
    a, b = ratios[0], round(ratios[0] + ratios[1], 12)
    return numbered.withColumn("split_set", F.when(share < a, "train").when(share < b, "val").otherwise("test")).drop("_rn", "n_rows")


def loso_folds(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """(all columns, fold, role): every subject is the test side of its own fold and trains the others.

    Each row once for each subject, as the definition asks: rows meet the table of subjects in the plan, so any number of
    subjects plans alike. For training use loso_filter instead.
    """
    folds = df.select(F.col(key).alias("fold")).filter(F.col("fold").isNotNull()).distinct()
    return _with_role(df.crossJoin(folds), key)


def folds_of(df: DataFrame, key: str = "subject_id") -> list:
    """The subjects, one fold and one fit each."""
    return [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key).toLocalIterator()]


def _with_role(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("role", F.when(F.col(key) == F.col("fold"), "test").otherwise("train"))


def loso_filter(df: DataFrame, fold: object, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold, as filters on the same table: no copies."""
    return df.filter(F.col(key) != fold), df.filter(F.col(key) == fold)


def leakage(folds: DataFrame, key: str = "subject_id") -> DataFrame:
    """(fold, subject) on both sides of a fold; must be empty."""
    side = lambda r: folds.filter(F.col("role") == r).select("fold", key)
    return side("train").intersect(side("test"))


def fold_weights(df: DataFrame, key: str = "subject_id", label: str = "label") -> DataFrame:
    """(fold, n_pos, n_neg, pos_weight) of each fold's training side: totals less the fold's own counts."""
    own = df.groupBy(F.col(key).alias("fold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = own.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))  # one row
    out = own.crossJoin(F.broadcast(total)).select("fold", (F.col("tp") - F.col("p")).alias("n_pos"), (F.col("tq") - F.col("q")).alias("n_neg"))
    return out.withColumn("pos_weight", F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0)))


def fold_moments(df: DataFrame, key: str, col: str) -> DataFrame:
    """(fold, n, mean, std) of the training side of each fold: the whole less the fold's own, on counts, means and squared
    deviations (sums of squares would cancel). std is of the population; 0 counts as 1.
    """
    own = df.groupBy(F.col(key).alias("fold")).agg(F.count(col).alias("n1"), F.avg(col).alias("m1"), (F.var_pop(col) * F.count(col)).alias("d1"))
    total = df.agg(F.count(col).alias("n"), F.avg(col).alias("m"), (F.var_pop(col) * F.count(col)).alias("d"))  # one row
    n2 = F.col("n") - F.col("n1")
    both = own.fillna(0.0, ["m1", "d1"]).crossJoin(F.broadcast(total)).withColumn("n2", n2)
    mean = (F.col("n") * F.col("m") - F.col("n1") * F.col("m1")) / F.nullif(F.col("n2"), F.lit(0))
    both = both.withColumn("mean", mean)
    gap = F.col("m1") - F.col("mean")
    d2 = F.greatest(F.lit(0.0), F.col("d") - F.col("d1") - gap * gap * F.col("n1") * F.col("n2") / F.col("n"))
    std = F.sqrt(d2 / F.nullif(F.col("n2"), F.lit(0)))
    return both.select("fold", F.col("n2").alias("n"), "mean", F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def fold_scale(df: DataFrame, key: str, col: str) -> DataFrame:
    """(df's columns, fold, role, z): col by the training statistics of each fold, for both sides of all folds.

    The statistics, one row a fold, meet the rows in the plan; nothing comes to the driver.
    """
    stats = fold_moments(df, key, col).filter("fold is not null").select("fold", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    rows = _with_role(df.crossJoin(stats), key)
    return rows.withColumn("z", (F.col(col) - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def scale_one_fold(df: DataFrame, moments: DataFrame, fold: object, key: str, col: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold with z by the fold's training statistics: filters, no copies."""
    m = moments.filter(F.col("fold") == fold).first()
    return tuple(x.withColumn("z", (F.col(col) - F.lit(m["mean"])) / F.lit(m["std"])) for x in loso_filter(df, fold, key))


def fold_scale_raw(df: DataFrame, key: str, arrays: str, steps: bool = False) -> DataFrame:
    """(fold, channel, n, mean, std) of array columns over all time steps of the training side, channel by channel.

    steps: a window is an array of time steps, each an array of channels; else one step.
    """
    rows = df.select(F.col(key), F.explode(arrays).alias("_s")) if steps else df.select(F.col(key), F.col(arrays).alias("_s"))
    rows = rows.select(key, F.posexplode("_s").alias("channel", "value"))
    own = rows.groupBy(F.col(key).alias("fold"), "channel").agg(F.count("value").alias("n1"), F.avg("value").alias("m1"), (F.var_pop("value") * F.count("value")).alias("d1"))
    total = rows.groupBy("channel").agg(F.count("value").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("d"))
    both = own.join(total, "channel").withColumn("n2", F.col("n") - F.col("n1"))
    both = both.withColumn("mean", (F.col("n") * F.col("m") - F.col("n1") * F.col("m1")) / F.nullif(F.col("n2"), F.lit(0)))
    gap = F.col("m1") - F.col("mean")
    d2 = F.greatest(F.lit(0.0), F.col("d") - F.col("d1") - gap * gap * F.col("n1") * F.col("n2") / F.col("n"))
    std = F.sqrt(d2 / F.nullif(F.col("n2"), F.lit(0)))
    return both.select("fold", "channel", F.col("n2").alias("n"), "mean", F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def scale_of(moments: DataFrame, fold: object) -> tuple[Sequence[float], Sequence[float]]:
    """Means and deviations of a fold's training side by channel."""
    rows = moments.filter(F.col("fold") == fold).orderBy("channel").toLocalIterator()
    return tuple(zip(*[(r["mean"], r["std"]) for r in rows], strict=True))


def apply_fold_scale_raw(df: DataFrame, moments: DataFrame, fold: object, key: str, arrays: str, steps: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold, the windows in `arrays` scaled channel by channel by the fold's training statistics.

    moments: of fold_scale_raw. steps: a window is an array of time steps, each an array of channels; else one step.
    """
    mean, std = (F.array(*[F.lit(float(x)) for x in v]) for v in scale_of(moments, fold))
    scaled = lambda step: F.zip_with(F.zip_with(step, mean, lambda v, m: v - m), std, lambda v, s: v / s)
    new = F.transform(arrays, scaled) if steps else scaled(F.col(arrays))
    return tuple(x.withColumn(arrays, new) for x in loso_filter(df, fold, key))


def sample_per_label(df: DataFrame, m: int, order: Sequence[str], label: str = "label", shares: int = 64) -> DataFrame:
    """At most m rows of each label, the first by `order` (a hash of the id for a random choice).

    The first m are found in each of `shares` shares of a label and then among those, so a label is in no task whole.
    """
    share = F.pmod(F.xxhash64(*order), F.lit(shares))
    for by in ([label, "_share"], [label]):
        df = df.withColumn("_share", share).withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= m)
    return df.drop("_rn", "_share")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds class_weight: rows / (classes * rows of the class); null labels are a class."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    all_n = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))  # one row
    w = n.crossJoin(F.broadcast(all_n)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("class_weight"))
    return joined(df, w, [label])


def user_split(df: DataFrame, key: str = "user_id", parts: int = 10, val: int = 2, test: int = 2) -> DataFrame:
    """Adds split_set by the user's number modulo parts: test first, then val, the rest train."""
    k = F.pmod(F.col(key), F.lit(parts))
    return df.withColumn("split_set", F.when(k < test, "test").when(k < test + val, "val").otherwise("train"))
