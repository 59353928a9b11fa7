"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and each run of white space counts as one space. Its features are the distinct character
n-grams that occur, hashed to BITS bits. The ratio r of a feature is the log of its smoothed share of toxic texts over
its share of the others. Kept are the features whose shares differ by more than chance would bring about in one of all
2^BITS (chi-square test); their number grows with the evidence and has no cap. Present features are scaled by r, and
MLlib's logistic regression is fitted on sparse vectors. Labels are learnt from a bounded sample of at most `most_labels`
training ids (half of each class, reweighted to the true shares); every text is scored. Sizes of n-grams, bits, test and
ridge were chosen by four folds inside the training rows of the test tables.

Defined cases: null and empty texts have no features and get the score of the intercept; a text of any length is
read whole; without labels of both classes every score is the share of toxic labels (0 without labels); rows of
repeated ids are learnt and scored one by one; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, pieces, written
from .labelled import sampled_labels

BITS = 22
SIZES = (4, 5, 6)
#: Texts whose vectors a task makes at once.
VECTORS = 256
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Model:
    """kept: hashes of the kept features, ascending; weight of each; intercept."""

    kept: np.ndarray
    weight: np.ndarray
    intercept: float


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram in the texts, with repeats."""
    clean = [" ".join((t or "").lower().split()) for t in texts]
    clean = [f" {t} " if t else "" for t in clean]
    text = np.repeat(np.arange(len(clean), dtype=np.int32), np.fromiter(map(len, clean), np.int64, len(clean)))
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    of, hashes = [], []
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(SIZES) + 1):
        # h[i]: hash of the n characters from i on
        h = h[: len(code) - n + 1] * np.uint32(MULTIPLIERS[0]) + code[n - 1 :] if len(code) >= n else h[:0]
        if n in SIZES:
            inside = text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(MULTIPLIERS[n % 3]) + np.uint32(n)
            of.append(text[: len(h)][inside])
            hashes.append((mixed >> np.uint32(32 - BITS))[inside])
    return np.concatenate(of), np.concatenate(hashes)


def distinct_grams(texts: list[str | None], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct n-gram hashes of each text, text after text. place: 2^BITS integers to work with."""
    of, h = grams(texts)
    order = np.argsort(of, kind="stable")
    h, ends = h[order], np.searchsorted(of[order], np.arange(len(texts) + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        mine, at = h[a:b], np.arange(b - a)
        place[mine] = at  # of equal hashes the last one stays
        out.append(mine[place[mine] == at])
    return np.concatenate([np.empty(0, np.uint32), *out]).astype(np.int32), np.cumsum([0, *map(len, out)]).astype(np.int32)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (y, h): the distinct hashes of each text."""
    place = np.zeros(1 << BITS, np.int32)
    for whole in batches:
        for b in pieces(whole, "text", 1 << 18):
            h, ends = distinct_grams(b["text"].to_pylist(), place)
            yield pa.RecordBatch.from_arrays([b["y"], pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], names=["y", "h"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, h) -> (h, n0, n1): how many of the task's texts of each class have the hash; h has each hash of a text once."""
    n = np.zeros((2, 1 << BITS), np.int32)
    for whole in batches:
        for i in range(0, whole.num_rows, VECTORS):
            b = whole.slice(i, VECTORS)
            for y in (0, 1):
                h, k = np.unique(pc.list_flatten(b["h"].filter(pc.equal(b["y"], y))).to_numpy(), return_counts=True)
                n[y, h] += k.astype(np.int32)
    found = np.flatnonzero(n.any(axis=0)).astype(np.int32)
    for i in range(0, len(found), 1 << 16):
        h = found[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(h), *[pa.array(n[y, h].astype(np.int64)) for y in (0, 1)]], names=["h", "n0", "n1"])


def _vectors(batches: Iterator[pa.RecordBatch], kept: np.ndarray, r: np.ndarray, weight: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """(y, h) -> (features, label, w): a text's kept features with their ratios as a sparse vector, as VectorUDT stores it."""
    for whole in batches:
        for i in range(0, whole.num_rows, VECTORS):
            b = whole.slice(i, VECTORS)
            of, h = pc.list_parent_indices(b["h"]).to_numpy(), pc.list_flatten(b["h"]).to_numpy()
            at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
            hit = kept[at] == h
            of, at = of[hit], at[hit]
            at = at[np.lexsort((at, of))].astype(np.int32)
            ends = pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32))
            size = pa.array(np.full(b.num_rows, len(kept), np.int32))
            parts = [pa.array(np.zeros(b.num_rows, np.int8)), size, pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(r[at]))]
            vector = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
            y = b["y"].to_numpy()
            yield pa.RecordBatch.from_arrays([vector, pa.array(y.astype(float)), pa.array(np.where(y == 1, weight[1], weight[0]))], names=["features", "label", "w"])


def least_chi_square(tests: int) -> float:
    """The chi-square value, one degree of freedom, that chance exceeds in one of so many tests."""
    return NormalDist().inv_cdf(1 - 0.5 / tests) ** 2


def ratios(counts: DataFrame, n: dict[int, int], least: float) -> DataFrame:
    """(h, r) of the features kept, from (h, n0, n1), the texts of each class that have the feature; n: texts of each."""
    p1 = (F.col("n1") + 1) / F.lit(n[1] + 2.0)
    p0 = (F.col("n0") + 1) / F.lit(n[0] + 2.0)
    all_p = (F.col("n0") + F.col("n1") + 1) / F.lit(n[0] + n[1] + 2.0)
    chi = F.pow(p1 - p0, F.lit(2.0)) / (all_p * (1 - all_p) * (1 / (n[1] + 2.0) + 1 / (n[0] + 2.0)))
    return counts.withColumn("r", F.log(p1 / p0)).filter(chi >= least).select("h", "r")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_labels: int = 20_000, ridge: float = 1e-3) -> Model:
    ids, share = sampled_labels(labels, label, most_labels)
    # the ids have a proven bound, so they are broadcast and no text is shuffled
    rows = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y").mapInArrow(_listed, "y int, h array<int>"))
    n = dict(rows.groupBy("y").count().collect())
    none = Model(np.empty(0, np.int32), np.empty(0), float(np.log((share[1] + 1e-6) / (1 - share[1] + 1e-6))))
    if not n.get(0) or not n.get(1):
        return none
    # tasks count for themselves, so the hashes of all texts are not exploded into one map of each task's heap
    counts = rows.mapInArrow(_counted, "h int, n0 long, n1 long").repartition("h").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    chosen = sorted(ratios(counts, n, least_chi_square(1 << BITS)).collect())
    if not chosen:
        return none
    kept, r = np.array([c["h"] for c in chosen], np.int32), np.array([c["r"] for c in chosen])

    weight = {y: share[y] / n[y] * (n[0] + n[1]) for y in (0, 1)}
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()), T.StructField("w", T.DoubleType())])
    train = rows.mapInArrow(partial(_vectors, kept=kept, r=r, weight=weight), schema)
    lr = LogisticRegression(maxIter=40, regParam=ridge, standardization=False, weightCol="w").fit(train)
    discard(rows)
    return Model(kept, r * np.array(lr.coefficients.toArray()), float(lr.intercept))


def margins(texts: list[str | None], model: Model, place: np.ndarray) -> np.ndarray:
    """Weighted sum of the kept features that each text has, once each. place: number of a hash among the kept, or -1."""
    of, h = grams(texts)
    at = place[h]
    hit = at >= 0
    key = np.unique(of[hit].astype(np.int64) << 32 | at[hit])
    return np.bincount(key >> 32, weights=model.weight[key & 0xFFFFFFFF], minlength=len(texts)) + model.intercept


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row: one map, no shuffle."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        place = np.full(1 << BITS, -1, np.int32)
        place[model.kept] = np.arange(len(model.kept))
        for whole in batches:
            for b in pieces(whole, "text", 1 << 18):
                z = margins(b["text"].to_pylist(), model, place)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "score"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")
