"""Models per leave-one-subject-out fold with MLlib; each fold is a filter on the same table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import new_path, written
from .evaluate import fold_results, fold_summary, sensitivity_bins
from .splits import apply_fold_scale_raw, fold_scale_raw, fold_weights, folds_of, loso_filter, scale_of

T_ = TypeVar("T_")


@dataclass
class Forest:
    trees: int = 100
    depth: int = 4
    leaf: int = 2
    seed: int = 42


@dataclass
class Svm:
    c: float = 1.0
    frequencies: int = 200
    steps: int = 50
    seed: int = 42


#: Folds whose fits run at the same time; each fit is a row of Spark jobs, so the cluster is shared among so many.
AT_ONCE = 5

#: Means and deviations by channel, which a task takes from its rows.
Scale = tuple[np.ndarray, np.ndarray] | None


def _numbers(lists: pa.ListArray, scale: Scale, null: float = np.nan) -> np.ndarray:
    """The lists as rows of numbers, scaled; null stands for what a list lacks or holds as null."""
    flat, n = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    d = len(scale[0]) if scale else int(n.max()) if len(n) else 0
    x, missing = np.full((len(n), d), np.nan), np.ones((len(n), d), bool)
    at = np.arange(d) < n[:, None]
    x[at], missing[at] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    x = (x - scale[0]) / scale[1] if scale else x
    x[missing] = null
    return x


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _vectors(df: DataFrame, of: Callable[[pa.ListArray], np.ndarray], keep: Sequence[str]) -> DataFrame:
    """The columns of keep, and `features` after `of` as MLlib's dense vectors, written as VectorUDT stores them."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, none = of(b["features"]), pa.nulls(b.num_rows, pa.int32())
            parts = [pa.array(np.ones(b.num_rows, np.int8)), none, pa.nulls(b.num_rows, pa.list_(pa.int32())), _lists(x)]
            vector = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vector, *[b[c] for c in keep]], names=["features", *keep])

    schema = T.StructType([T.StructField("features", VectorUDT()), *[df.schema[c] for c in keep]])
    return df.select("features", *keep).mapInArrow(run, schema)


def _each_fold(spark: SparkSession, folds: Sequence, run: Callable[[object], T_], at_once: int = AT_ONCE) -> list[T_]:
    """run(fold) of every fold, at_once of them side by side, in the order of folds."""
    with ThreadPool(max(1, min(at_once, len(folds)))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), list(folds))


def _table(parts: Sequence[str], spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _scores_schema(df: DataFrame, key: str, id_col: str) -> T.StructType:
    return T.StructType([T.StructField("fold", df.schema[key].dataType), T.StructField(id_col, df.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("p", T.DoubleType())])


class _Folds:
    """A labelled table, written once, and its folds: each a filter, scaled and weighted by its own training side."""

    def __init__(self, df: DataFrame, key: str, id_col: str, folds: Sequence | None, scaled: bool, weighted: bool, raw: str | None) -> None:
        self.spark, self.key, self.id_col, self.schema = df.sparkSession, key, id_col, _scores_schema(df, key, id_col)
        column = raw or "features"
        self.data = written(df.select(key, id_col, F.col("label").cast("double").alias("label"), F.col(column).alias("features")), "folds")
        self.steps = raw is not None
        self.folds = list(folds) if folds is not None else folds_of(self.data, key)
        moments = fold_scale_raw(self.data, key, "features", self.steps) if scaled else None
        # a few numbers for each fold that is fitted
        self.moments = moments and written(moments, "moments")
        self.weights = written(fold_weights(self.data, key), "weights") if weighted else None
        self.path = new_path(self.spark, "scores")

    def sides(self, fold: object, data: DataFrame | None = None) -> tuple[list[DataFrame], Scale]:
        """Training and test side: features (one array of numbers), label, weight; and how to scale the features.

        Arrays are scaled inside the task that turns them into vectors; windows of steps are scaled here.
        """
        data, scale = self.data if data is None else data, None
        both = loso_filter(data, fold, self.key)
        if self.moments is not None and self.steps:
            both = apply_fold_scale_raw(data, self.moments, fold, self.key, "features")
        elif self.moments is not None:
            scale = tuple(np.array(v, float) for v in scale_of(self.moments, fold))
        if self.steps:
            both = [x.withColumn("features", F.flatten("features")) for x in both]
        found = self.weights and self.weights.filter(F.col("fold") == fold).select("pos_weight").first()
        w = F.when(F.col("label") == 1, F.lit(float(found[0]))).otherwise(1.0) if found and found[0] else F.lit(1.0)
        return [x.withColumn("weight", w) for x in both], scale

    def write(self, fold: object, k: int, scored: DataFrame) -> str:
        """The fold's scores as a table of their own, so that nothing fits or scores again when they are read."""
        out = scored.select(F.lit(fold).cast(self.schema["fold"].dataType).alias("fold"), self.id_col, F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        out.write.parquet(f"{self.path}/{k}")
        return f"{self.path}/{k}"

    def scores(self, parts: Sequence[str]) -> DataFrame:
        return _table(parts, self.spark, self.schema)


def loso_rf(
    df: DataFrame, cfg: Forest = Forest(), folds: Sequence | None = None, key: str = "subject_id", id_col: str = "window_id",
    scaled: bool = False, weighted: bool = False, raw: str | None = None, at_once: int = AT_ONCE,
) -> tuple[DataFrame, DataFrame]:
    """(scores, importances) of a random forest for each fold, fitted side by side.

    df: key, id_col, label, features (array). scores: fold, id_col, y, p. importances: fold, feature, importance. scaled: by
    the training side's moments; weighted: positives weigh negatives / positives of the training side; raw: a column of
    windows (arrays of time steps of channels) to take in place of features, scaled by channel over all steps.
    """
    whole = _Folds(df, key, id_col, folds, scaled, weighted, raw)
    # a forest's draws depend on the order of rows, which that of files is not; all folds take their rows from one deal
    dealt = whole.data.repartition(int(whole.spark.conf.get("spark.sql.shuffle.partitions")), key, id_col).sortWithinPartitions(key, id_col).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(k: int) -> tuple[str, list[tuple]]:
        fold = whole.folds[k]
        sides, scale = whole.sides(fold, dealt)
        # MLlib's vectors have 0 for null
        train, test = (_vectors(x, lambda v: _numbers(v, scale, 0.0), [key, id_col, "label", "weight"]) for x in sides)
        rf = RandomForestClassifier(numTrees=cfg.trees, maxDepth=cfg.depth, minInstancesPerNode=cfg.leaf, seed=cfg.seed, weightCol="weight").fit(train)
        return whole.write(fold, k, rf.transform(test)), [(fold, j, float(v)) for j, v in enumerate(rf.featureImportances.toArray())]

    try:
        done = _each_fold(whole.spark, range(len(whole.folds)), fit, at_once)
    finally:
        dealt.unpersist()
    schema = T.StructType([T.StructField("fold", df.schema[key].dataType), T.StructField("feature", T.IntegerType()), T.StructField("importance", T.DoubleType())])
    return whole.scores([p for p, _ in done]), df.sparkSession.createDataFrame([w for _, ws in done for w in ws], schema)


def _waves(d: int, gamma: float, cfg: Svm) -> Callable[[np.ndarray], np.ndarray]:
    """Random Fourier features of rows of d numbers."""
    rng = np.random.default_rng(cfg.seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (cfg.frequencies, d))
    shift = rng.uniform(0, 2 * np.pi, cfg.frequencies)
    scale = float(np.sqrt(2 / cfg.frequencies))
    return lambda x: np.cos(x @ w.T + shift) * scale


def fourier_features(df: DataFrame, d: int, gamma: float, cfg: Svm, col: str = "features", out: str = "rff") -> DataFrame:
    """Adds random Fourier features: their inner product approximates the kernel exp(-gamma |x - y|^2)."""
    waves = _waves(d, gamma, cfg)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(x: pa.Array) -> pa.Array:
        return _lists(waves(_numbers(x, None)) if len(x) else np.empty((0, cfg.frequencies)))

    return df.withColumn(out, project(col))


def fourier_margins(df: DataFrame, d: int, gamma: float, cfg: Svm, weights: np.ndarray, intercept: float, col: str = "features", out: str = "margin", scale: Scale = None) -> DataFrame:
    """Adds the margin of a linear machine on random Fourier features, which stay inside the task."""
    waves = _waves(d, gamma, cfg)

    @F.arrow_udf(T.DoubleType())
    def margin(x: pa.Array) -> pa.Array:
        return pa.array(waves(_numbers(x, scale)) @ weights + intercept if len(x) else np.empty(0))

    return df.withColumn(out, margin(col))


def loso_svm(
    df: DataFrame, cfg: Svm = Svm(), folds: Sequence | None = None, key: str = "subject_id", id_col: str = "window_id",
    weighted: bool = False, raw: str | None = None, at_once: int = AT_ONCE,
) -> DataFrame:
    """(fold, id_col, y, p) of an RBF support vector machine for each fold, fitted side by side.

    Features are scaled by the fold's training side. An approximation: a linear machine on random Fourier features with
    gamma = 1 / (features * variance), and the probability from a logistic fit on its margin. MLlib's objective is the
    mean hinge loss plus half its regParam times |w|^2, so a machine's C is regParam = 1 / (C rows). weighted, raw: as in
    loso_rf.
    """
    whole = _Folds(df, key, id_col, folds, True, weighted, raw)

    def fit(k: int) -> str:
        fold = whole.folds[k]
        sides, scale = whole.sides(fold)
        d, n, var = _shape(sides[0], scale)
        waves = _waves(d, 1 / (d * var), cfg)
        train = _vectors(sides[0], lambda v: waves(_numbers(v, scale)), ["label", "weight"])
        svm = LinearSVC(featuresCol="features", labelCol="label", maxIter=cfg.steps, regParam=1 / (cfg.c * max(1, n)), standardization=False, rawPredictionCol="raw", predictionCol="hard", weightCol="weight").fit(train)
        # one number a row is written, so the logistic fit lifts nothing again
        margins = [fourier_margins(x, d, 1 / (d * var), cfg, svm.coefficients.toArray(), svm.intercept, scale=scale).select(key, id_col, "label", "margin") for x in sides]
        margins[0] = written(margins[0].select("label", "margin"), "margins")
        margins = [x.withColumn("m", array_to_vector(F.array("margin"))) for x in margins]
        platt = LogisticRegression(featuresCol="m", labelCol="label", maxIter=30).fit(margins[0])
        return whole.write(fold, k, platt.transform(margins[1]))

    return whole.scores(_each_fold(whole.spark, range(len(whole.folds)), fit, at_once))


def _shape(train: DataFrame, scale: Scale = None) -> tuple[int, int, float]:
    """Features, rows and variance of all features' scaled values together (1 if there is none)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, x = pc.list_flatten(b["features"]), _numbers(b["features"], scale, 0.0)
                row = {"d": x.shape[1], "n": b.num_rows, "k": len(flat) - flat.null_count, "ones": float(x.sum()), "squares": float((x * x).sum())}
                yield pa.RecordBatch.from_pylist([row])

    parts = train.select("features").mapInArrow(sums, "d long, n long, k long, ones double, squares double")
    d, n, k, ones, squares = parts.agg(F.max("d"), *[F.sum(c) for c in ("n", "k", "ones", "squares")]).first()
    # scaled features lie around zero, so the squares do not cancel
    var = squares / k - (ones / k) ** 2 if k else None
    return d or 1, n or 0, var or 1.0


def importance_summary(importances: DataFrame) -> DataFrame:
    """(feature, mean, std) over the folds, largest mean first."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std")).orderBy(F.desc("mean"), "feature")


def fit_pipeline(df: DataFrame, cols: Sequence[str], path: str, cfg: Forest = Forest()) -> None:
    """Fits a forest on columns of df and saves it with its assembler."""
    steps = [VectorAssembler(inputCols=list(cols), outputCol="features"), RandomForestClassifier(numTrees=cfg.trees, maxDepth=cfg.depth, minInstancesPerNode=cfg.leaf, seed=cfg.seed)]
    Pipeline(stages=steps).fit(df).write().overwrite().save(path)


def score(df: DataFrame, path: str) -> DataFrame:
    """df with predicted class and its confidence by the saved model."""
    done = PipelineModel.load(path).transform(df)
    return done.withColumn("predicted", F.col("prediction").cast("int")).withColumn("confidence", F.array_max(vector_to_array("probability"))).select(*df.columns, "predicted", "confidence")


@dataclass
class Run:
    """What a leave-one-subject-out run gives: (fold, id, y, p, time_to_loc), (fold, auc, ...), (metric, mean, std), (bin_s, sensitivity), (feature, mean, std)."""

    scores: DataFrame
    results: DataFrame
    summary: DataFrame
    bins: DataFrame
    importances: DataFrame


#: The kinds of models by name, with their default settings.
MODELS = {"rf": Forest, "svm": Svm}


def loso_run(
    df: DataFrame, cfg: Forest | Svm | str = "rf", threshold: float = 0.5, key: str = "subject_id", id_col: str = "window_id",
    weighted: bool = False, raw: str | None = None, bins: Sequence[float] = (60, 20, 10, 0), step_seconds: float = 1.0, at_once: int = AT_ONCE,
) -> Run:
    """The whole training job: for each subject left out, features scaled by the others, a model fitted and the subject's
    windows scored; then folds evaluated and summed up.

    df: key, id_col, label, features (array), time_to_loc; or the windows of column raw. cfg: a model's settings or its
    name, rf or svm. Scores are written once, and every figure is read from them. Importances are those of forests.
    """
    cfg = MODELS[cfg]() if isinstance(cfg, str) else cfg
    if isinstance(cfg, Forest):
        scores, importances = loso_rf(df, cfg, None, key, id_col, True, weighted, raw, at_once)
    else:
        scores = loso_svm(df, cfg, None, key, id_col, weighted, raw, at_once)
        importances = df.sparkSession.createDataFrame([], T.StructType([scores.schema["fold"], T.StructField("feature", T.IntegerType()), T.StructField("importance", T.DoubleType())]))
    scores = written(scores.join(df.select(F.col(key).alias("fold"), id_col, "time_to_loc"), ["fold", id_col]), "scored")
    results = written(fold_results(scores, threshold, step_seconds), "results")
    return Run(scores, results, fold_summary(results), sensitivity_bins(results, bins), importance_summary(importances))
