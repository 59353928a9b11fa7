"""Evaluation of scored windows (fold, window_id, y, p, time_to_loc) and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import joined


#: Ranges of score into which a fold is cut; a range is one task's work.
RANGES = 4096


def _by_score(df: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """(keys, p, pos, neg, pos_upto, neg_upto, n_pos, n_neg): counts at each distinct score, running counts up to and with
    it in order of score, and the totals.

    A fold is summed up by score first; its scores are then swept in ranges, each by itself, with the counts of the
    ranges before carried over by one row each, so no fold is sorted whole in one task. A null score is lowest.
    """
    g = df.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    ends = g.groupBy(*keys).agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    share = (F.col("p") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    at = F.coalesce(share, F.lit(0.0)) * RANGES
    at = F.when(F.col("p").isNull(), F.lit(-1.0)).when(F.isnan(at), F.lit(float(RANGES + 1))).otherwise(at)
    order = F.when(F.col("p").isNull(), F.lit(float("-inf"))).otherwise(F.col("p"))
    part = F.floor(-at if descending else at).cast("long")
    g = joined(g, ends, keys).withColumns({"_part": part, "_p": -order if descending else order}).drop("_lo", "_hi")
    sums = g.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in ("pos", "neg")])
    fold = Window.partitionBy(*keys)
    before = fold.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_past_{c}") for c in ("pos", "neg")], *[F.sum(f"_{c}").over(fold).alias(f"n_{c}") for c in ("pos", "neg")])
    within = Window.partitionBy(*keys, "_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    here = g.withColumns({f"{c}_upto": F.sum(c).over(within) for c in ("pos", "neg")})
    both = joined(here, past, [*keys, "_part"])
    return both.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_past_{c}") for c in ("pos", "neg")}).drop("_part", "_p", "_past_pos", "_past_neg")


def fold_auc(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, auc): ties count half; null where a class is missing."""
    s = _by_score(df, [fold]).withColumn("won", F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    g = s.groupBy(fold).agg(F.sum("won").alias("w"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return g.select(fold, (F.col("w") / F.nullif(F.col("a") * F.col("b"), F.lit(0))).alias("auc"))


def first_detection(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(fold, has_loc, first_detection_time): longest time ahead at which a fold with a loss was detected, else null."""
    t = F.when((F.col("p") >= threshold) & (F.col("time_to_loc") > 0), F.col("time_to_loc"))
    g = df.groupBy("fold").agg(F.bool_or(F.col("y") == 1).alias("has_loc"), F.max(t).alias("t"))
    return g.select("fold", "has_loc", F.when(F.col("has_loc"), F.col("t")).alias("first_detection_time"))


def false_alarm_rate(df: DataFrame, threshold: float = 0.5, step_seconds: float = 1.0) -> DataFrame:
    """(fold, false_alarm_rate): alarms by hour of negative windows; 0 without any."""
    g = df.groupBy("fold").agg(F.count_if((F.col("y") == 0) & (F.col("p") >= threshold)).alias("a"), F.count_if(F.col("y") == 0).alias("n"))
    hours = F.col("n") * F.lit(step_seconds / 3600.0)
    return g.select("fold", F.coalesce(F.col("a") / F.nullif(hours, F.lit(0.0)), F.lit(0.0)).alias("false_alarm_rate"))


def fold_results(df: DataFrame, threshold: float = 0.5, step_seconds: float = 1.0) -> DataFrame:
    return fold_auc(df).join(first_detection(df, threshold), "fold").join(false_alarm_rate(df, threshold, step_seconds), "fold")


def fold_summary(results: DataFrame, cols: Sequence[str] = ("auc", "first_detection_time", "false_alarm_rate")) -> DataFrame:
    """(metric, mean, std) over folds; nulls are skipped, std is of the population."""
    return results.unpivot(["fold"], list(cols), "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def sensitivity_bins(results: DataFrame, bins: Sequence[float] = (60, 20, 10, 0)) -> DataFrame:
    """(bin_s, sensitivity): share of folds with a loss that were detected at least bin_s ahead; null without such folds."""
    loss = F.col("has_loc")
    hit = lambda b: F.count_if(loss & (F.coalesce("first_detection_time", F.lit(-1.0)) >= b))
    one = results.agg(F.count_if(loss).alias("n"), *[hit(float(b)).alias(f"h{i}") for i, b in enumerate(bins)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bin_s"), F.col(f"h{i}").alias("h")) for i, b in enumerate(bins)]))
    return one.select("n", rows.alias("r")).select("r.bin_s", (F.col("r.h") / F.nullif(F.col("n"), F.lit(0))).alias("sensitivity"))


def _counts(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    hit = F.col("p") >= threshold
    return df.groupBy(*keys).agg(
        F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if((F.col("y") == 0) & hit).alias("fp"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"), F.count_if((F.col("y") == 0) & ~hit).alias("tn")
    )


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(y, predicted, n) for all four cells, absent ones as 0."""
    c = _counts(df, [], threshold)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(q).alias("predicted"), F.col(k).alias("n")) for y, q, k in cells])).alias("r")).select("r.*")


def class_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(fold, accuracy, precision, recall, specificity, f1) of class 1; null where a share has no base."""
    c = _counts(df, ["fold"], threshold)
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(
        "fold", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(tn, tn + fp).alias("specificity"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_curve(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, threshold, tpr, fpr) at each distinct score, from the highest down."""
    rate = lambda c: F.col(f"{c}_upto") / F.nullif(F.col(f"n_{c}"), F.lit(0))
    return _by_score(df, [fold], True).select(fold, F.col("p").alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def worst_errors(df: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    wrong = df.filter((F.col("p") >= threshold).cast("int") != F.col("y")).withColumn("error", F.abs(F.col("p") - F.col("y")))
    return wrong.orderBy(F.desc("error"), "window_id").limit(k)


def subject_report(df: DataFrame, key: str = "fold", value: str = "p") -> DataFrame:
    """(key, n, mean, ci_low, ci_high): mean with its 95 % interval; the interval is null for one row."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    half = F.lit(1.96) * F.col("s") / F.sqrt("n")
    return g.select(key, "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def alerts(df: DataFrame, caution: float = 0.5, alert: float = 0.8) -> DataFrame:
    """(fold, window_id, level, message) for windows at or over the thresholds."""
    level = F.when(F.col("p") >= alert, "alert").when(F.col("p") >= caution, "caution")
    action = F.when(F.col("level") == "alert", "lie down now").otherwise("sit down")
    message = F.concat(F.col("level"), F.lit(": risk "), F.round(F.col("p") * 100).cast("int").cast("string"), F.lit("% at window "), F.col("window_id").cast("string"), F.lit(", "), action)
    return df.withColumn("level", level).filter("level is not null").select("fold", "window_id", "level", message.alias("message"))
