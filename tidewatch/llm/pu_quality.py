"""Quality by positive-unlabelled learning: a linear model of text shape under the non-negative unbiased risk.

Trusted positives are training rows labelled 1; all other text counts as unlabelled. With class prior p and squared loss
l(z) = (1 - z)^2 / 4 the risk is p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]). All its terms are quadratic in
the weights, so the sums of the features and of their products say all there is to know of the rows: one pass over
every unlabelled text adds them up in the tasks, partial sums are added group by group, and the driver solves for the
weights, whatever the number of texts. Where the second term would fall below zero, it is held at zero.

The prior is estimated from positive and unlabelled text alone: a model fitted without a fifth of the positives scores
these and all unlabelled text; the share of unlabelled text above a threshold over the share of held-back positives
above it is an upper bound of the prior at every threshold, and the least such bound is taken.

The features don't depend on language: how often each class of characters follows each other, word and line lengths,
repeats. Negative labels are never used. The positives are a bounded sample (`most_positives` ids); nothing else is.

Defined cases: null and empty texts have all features 0 and are scored like any other; texts of any length are read
whole; without positives every score is 0.5; repeated rows and ids count one by one; null ids are unlabelled; other
columns are kept, but one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, summed
from .labelled import held_out, sampled_labels

# Classes of bytes; what is not listed is of class 0.
CLASSES = ["", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "\"'`", "()[]{}<>", "*#$%&@^~=+", "-_/\\"]
LEAD, INNER = len(CLASSES), len(CLASSES) + 1
N = len(CLASSES) + 2
CLASS_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in _chars]] = _k
CLASS_OF[0x80:0xC0] = INNER
CLASS_OF[0xC0:] = LEAD
N_FEATURES = N * N + 6


def features(texts: list[str | None]) -> np.ndarray:
    """One row of N_FEATURES numbers for each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    of = np.repeat(np.arange(len(raw)), n)
    kind = CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    inside = of[1:] == of[:-1]
    pair = np.bincount((of[1:] * (N * N) + kind[:-1] * N + kind[1:])[inside], minlength=len(raw) * N * N)
    pair = pair.reshape(len(raw), N * N) / np.maximum(n - 1, 1)[:, None]
    more = np.zeros((len(raw), 6))
    for i, t in enumerate(raw):
        words, lines = t.split(), t.split(b"\n")
        if words:
            more[i] = (np.log1p(len(words)) / 5, len(t) / len(words) / 10, len(set(words)) / len(words), len(set(lines)) / len(lines), np.log1p(len(t) / len(lines)) / 5, max(map(len, words)) / 100)
    return np.hstack([np.sqrt(pair), np.minimum(more, 3)])


@dataclass
class Model:
    """g(x) = x . weight + intercept, an estimate of 2 P(positive | x) - 1."""

    weight: np.ndarray
    intercept: float
    prior: float


def link(g: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 that rises with g and equals the probability (1 + g) / 2 at 0.3, 0.5 and 0.7."""
    return 1 / (1 + np.exp(-np.clip(np.log(0.7 / 0.3) / 0.4 * g, -60, 60)))


def _loss(w: np.ndarray, s: np.ndarray, sign: int) -> float:
    """Mean of l(sign * w . x) over rows whose sum of x x^T is s; the last x is always 1."""
    return float((1 - 2 * sign * (s[-1] @ w) / s[-1, -1] + w @ s @ w / s[-1, -1]) / 4)


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights that minimise the non-negative risk plus ridge / 2 |w|^2 (not for the last, the intercept).

    pos, unl: sums of x x^T of positive and unlabelled rows, the last component of x being 1. The minimum of
    p l_pos(g) + t (l_unl(-g) - p l_pos(-g)) is linear algebra for each t. t = 1 unless the second term is below zero
    there; then the t from 0 to 1 is found at which it is zero.
    """
    mp, mu = pos / pos[-1, -1], unl / unl[-1, -1]
    r = 2 * ridge * np.eye(len(mp))
    r[-1, -1] = 1e-9

    def solved(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * mp + t * mu + r, prior * (1 + t) * mp[-1] - t * mu[-1])

    def negative(w: np.ndarray) -> float:
        return _loss(w, unl, -1) - prior * _loss(w, pos, -1)

    w = solved(1.0)
    if negative(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(40):
        t = (low + high) / 2
        w = solved(t)
        low, high = (low, t) if negative(w) < 0 else (t, high)
    return solved(low) if low else w


def prior_of(held: np.ndarray, unl: np.ndarray) -> float:
    """Least ratio of the shares of unlabelled rows and held-back positives in the upper bins of a histogram of scores."""
    h, u = np.cumsum(held[::-1]), np.cumsum(unl[::-1])
    some = h >= 0.1 * h[-1]
    return float(np.clip(((u[some] + 1) / (u[-1] + 1) / (h[some] / h[-1])).min(), 0.02, 0.98)) if h[-1] else 0.5


BINS = np.linspace(-3, 3, 1201)
#: Rows: neither, unlabelled only, positive, positive that is held back for the prior. All but the first are unlabelled too.
NEITHER, UNLABELLED, POSITIVE, HELD_BACK = 0, 1, 2, 3


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x x^T of this partition's unlabelled, positive and held-back rows, x ending in 1."""
    sums = np.zeros((3, N_FEATURES + 1, N_FEATURES + 1))
    for whole in batches:
        for b in pieces(whole, "text", 1 << 19):
            x, part = features(b["text"].to_pylist()), b["part"].to_numpy()
            x = np.hstack([x, np.ones((len(x), 1))])
            for k, rows in enumerate((x[part != NEITHER], x[part == POSITIVE], x[part == HELD_BACK])):
                sums[k] += rows.T @ rows
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["k", "x"])


def _histogram(model: Model):
    """Counts of unlabelled and held-back rows in bins of g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(BINS) + 1))
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                at, part = np.searchsorted(BINS, features(b["text"].to_pylist()) @ model.weight + model.intercept), b["part"].to_numpy()
                for k, rows in enumerate((part != NEITHER, part == HELD_BACK)):
                    n[k] += np.bincount(at[rows], minlength=len(BINS) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["k", "x"])

    return run


def _model(pos: np.ndarray, unl: np.ndarray, prior: float) -> Model:
    """Fits on features brought to mean 0 and deviation 1 over the unlabelled rows."""
    mean = unl[-1, :-1] / unl[-1, -1]
    std = np.sqrt(np.maximum(np.diag(unl)[:-1] / unl[-1, -1] - mean**2, 0))
    scale = np.where(std < 1e-6, 0, 1 / np.maximum(std, 1e-6))
    t = np.diag(np.append(scale, 1.0))
    t[:-1, -1] = -mean * scale
    w = nn_pu(t @ pos @ t.T, t @ unl @ t.T, prior)
    return Model(w[:-1] * scale, float(w[-1] - (w[:-1] * scale) @ mean), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_positives: int = 10_000) -> Model:
    """Learns from docs (doc_id, text) outside the held-out fold; of labels (doc_id, label) only 1s are used, of at most
    most_positives ids.
    """
    ids, _ = sampled_labels(labels, label, 2 * most_positives)
    positives = ids.filter("y = 1").select("doc_id", F.lit(True).alias("_known"))  # most_positives at most
    back = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 0
    part = F.when(held_out(F.col("doc_id")), NEITHER).when(F.col("_known") & back, HELD_BACK).when(F.col("_known"), POSITIVE).otherwise(UNLABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(positives), "doc_id", "left").select("text", part.alias("part")).filter(F.col("part") != NEITHER)
    n = N_FEATURES + 1
    unl, pos, back_pos = summed(rows.mapInArrow(_sums, "k int, x binary")).get(0, np.zeros(3 * n * n)).reshape(3, n, n)
    if not (pos + back_pos)[-1, -1]:
        return Model(np.zeros(N_FEATURES), 0.0, 0.5)
    prior = 0.5
    if pos[-1, -1] and back_pos[-1, -1]:
        first = _model(pos, unl, 0.5)
        counts = summed(rows.mapInArrow(_histogram(first), "k int, x binary"))[0].reshape(2, -1)
        prior = prior_of(counts[1], counts[0])
    return _model(pos + back_pos, unl, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score: one map, no shuffle."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                s = link(features(b["text"].to_pylist()) @ model.weight + model.intercept)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, score double")
