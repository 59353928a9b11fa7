"""Exact top-k inner products over integer vectors: candidates by descending length, SVD-rotated partial sums.

All vectors are rotated by the eigenvectors of their Gram matrix, so the first coordinates carry most of an inner
product. Candidates are range-sorted by descending length and cut into chunks. The chunk of the longest ones gives
each query a first k-th score; a later chunk is visited only by queries for which its longest vector could still
win (Cauchy-Schwarz on the whole length). Inside a chunk the candidates are worked off by descending length in
blocks: a block's partial sums over the first coordinates plus the product of the residual lengths bound each score,
and only pairs whose bound reaches the query's k-th score are multiplied out, exactly in integers.

Queries meet the candidates in blocks: every group holds one chunk and one block of queries, both of fixed size, and
returns k rows for each of its queries; these are merged by a window over each query. A chunk is sent to those blocks
only in which some query still wants it.

Defined cases: null vectors, null or non-finite components and vectors of another length than most take no part, as
query or candidate; ties go to the smaller id; a query gets all candidates if there are fewer than k; rows with equal
ids are told apart as rows, but a query never meets rows with its own id, equal queries are one, and different queries
of one id share its k places; null ids take no part. Components beyond
2^62 count as that, and scores beyond a long as the largest or smallest long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .sweep import running_total
from .vectors import block, packed, unpacked

CHUNK, QUERIES, STEP, HEAD, SPANS = 8192, 2048, 1024, 16, 512
#: A chunk meets the blocks that want it in this many parts, so that no task makes all copies of a chunk.
CHUNK_PARTS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
OUT = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, scale: int, d: int) -> DataFrame:
    """(vec_id, v, norm) of the usable rows: v holds floor(scale * x) as int64, norm its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = block(b["embedding"], d)
            v = np.clip(np.floor(x[ok] * scale), -(2.0**62), 2.0**62)
            yield pa.RecordBatch.from_arrays([b["vec_id"].filter(pa.array(ok)), packed(v.astype(np.int64)), pa.array(np.sqrt((v * v).sum(1)))], names=["vec_id", "v", "norm"])

    return df.filter("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary, norm double")


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first: from d x d Gram matrices summed over the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = unpacked(b["v"], np.int64, d).astype(float)
                gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(gram.ravel())], names=["i", "g"])

    sums = vectors.select("v").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(d * d)
    for row in sums:
        gram[row["i"]] = row["g"]
    return np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1].copy()


def products(q: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of the rows of q with those of x (int64), held within a long.

    longest: a bound of |q| |x|. Below 2^53 no partial sum leaves the integers that doubles hold, below 2^62 none
    leaves a long, so both ways are exact; beyond, Python's integers are used.
    """
    if longest < 2.0**52:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if longest < 2.0**62:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.minimum(np.maximum(exact, LEAST), MOST).astype(np.int64)


def _searched(k: int, d: int, basis: np.ndarray):
    """Function of one chunk of candidates and one block of queries (with `least`, a score they must reach)."""
    head = min(HEAD, d)

    def run(cands: pa.Table, queries: pa.Table) -> pa.Table:
        n = queries.num_rows
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not n or not cands.num_rows:
            return pa.table(empty)
        q = unpacked(queries["v"].combine_chunks(), np.int64, d)
        x = unpacked(cands["v"].combine_chunks(), np.int64, d)
        qid, xid = queries["vec_id"].to_numpy(), cands["vec_id"].to_numpy()
        norm = cands["norm"].to_numpy()
        order = np.lexsort((xid, -norm))
        x, xid, norm = x[order], xid[order], norm[order]
        least = queries["least"].to_numpy().copy()
        qr, xr = q @ basis, x @ basis
        q_rest = np.sqrt(np.maximum((qr[:, head:] ** 2).sum(1), 0))
        x_rest = np.sqrt(np.maximum((xr[:, head:] ** 2).sum(1), 0))
        qn = np.sqrt((q.astype(float) ** 2).sum(1))
        got_q, got_x, got_s = (np.empty(0, np.int64) for _ in range(3))
        for at in range(0, len(x), STEP):
            # bounds are in doubles: they are widened by more than their error, which goes with |q| |x|
            alive = np.flatnonzero(qn * norm[at] * (1 + 1e-9) + 1e-3 >= least)
            if not len(alive):
                break
            part = slice(at, at + STEP)
            bound = qr[alive, :head] @ xr[part, :head].T + q_rest[alive, None] * x_rest[part]
            i, j = np.nonzero(bound + 1e-9 * qn[alive, None] * norm[part] + 1e-3 >= least[alive, None])
            other = qid[alive[i]] != xid[at + j]
            i, j = i[other], j[other]
            # the rows and columns that some pair still needs
            rows, cols = np.unique(i), np.unique(j)
            s = products(q[alive[rows]], x[at + cols], float(qn[alive[rows]].max(initial=0) * norm[at]))[np.searchsorted(rows, i), np.searchsorted(cols, j)]
            i, j = alive[i], at + j
            good = s >= least[i]
            got_q, got_x, got_s = (np.concatenate(p) for p in ((got_q, i[good]), (got_x, j[good]), (got_s, s[good])))
            # keep the k best of each query and raise the score that must be reached
            best = np.lexsort((xid[got_x], ~got_s, got_q))
            got_q, got_x, got_s = got_q[best], got_x[best], got_s[best]
            first = np.searchsorted(got_q, got_q)
            keep = np.arange(len(got_q)) - first < k
            kth = np.arange(len(got_q)) - first == k - 1
            least[got_q[kth]] = np.maximum(least[got_q[kth]], got_s[kth])
            got_q, got_x, got_s = got_q[keep], got_x[keep], got_s[keep]
        return pa.table({"query_id": qid[got_q], "vec_id": xid[got_x], "score": got_s})

    return run


def wanted(cands: DataFrame, queries: DataFrame) -> DataFrame:
    """Each candidate once for each block of queries in which some query wants its chunk.

    Every block wants the first chunk, so the join is on a part of the chunk too: a task copies 1/CHUNK_PARTS of one.
    """
    pairs = queries.select(F.col("chunk").alias("_chunk"), F.col("block").alias("_block")).distinct()
    pairs = pairs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_PARTS - 1))))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(CHUNK_PARTS)).cast("int")
    met = cands.withColumn("part", part).join(pairs, (F.col("chunk") == F.col("_chunk")) & (F.col("part") == F.col("_part")))
    return met.select("chunk", F.col("_block").alias("block"), "vec_id", "v", "norm")


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all rows of other ids.

    df: vec_id, embedding; is_query: which of its rows are queries too.
    """
    d = df.filter("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = d["d"] if d and d["d"] else 1
    vectors = written(quantised(df, scale, d))
    basis = rotation(vectors, d)
    chunk = F.floor((F.col("nth") - 1) / CHUNK).cast("int").alias("chunk")
    cands = running_total(vectors.withColumn("down", -F.col("norm")), ["down", "vec_id"], None, "nth", ["vec_id", "v", "norm", chunk])
    queries = vectors.filter(is_query).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-queries.count() // QUERIES))
    # the first chunk is a written column: as a literal it would turn the join on it into a cross join
    queries = written(queries.withColumns({"block": F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"), "chunk": F.lit(0)}))
    discard(vectors)
    chunks = cands.groupBy("chunk").agg(F.max("norm").alias("longest"))
    run = _searched(k, d, basis)

    def visit(q: DataFrame) -> DataFrame:
        q = q.select("chunk", "block", "vec_id", "v", "least")
        return wanted(cands, q).groupBy("chunk", "block").cogroup(q.groupBy("chunk", "block")).applyInArrow(run, OUT)

    first = written(visit(queries.withColumn("least", F.lit(LEAST))))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = queries.drop("chunk").join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("least", F.coalesce("kth", F.lit(LEAST)))
    # chunks descend in length, so a query visits them up to some number, told here from at most SPANS runs of chunks
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    run_of = F.floor(F.col("chunk") / F.lit(-(-(last + 1) // SPANS)))
    spans = chunks.filter("chunk > 0").groupBy(run_of).agg(F.max("longest").alias("longest"), F.max("chunk").alias("to")).collect()
    found = first
    if spans:
        known = F.array(*[F.struct(F.lit(x["longest"]).alias("longest"), F.lit(x["to"]).alias("to")) for x in spans])
        reach = F.filter(known, lambda c: F.col("norm") * c["longest"] * (1 + 1e-9) + 1e-3 >= F.col("least"))
        rest = rest.withColumn("to", F.array_max(F.transform(reach, lambda c: c["to"]))).filter("to is not null")
        rest = rest.select("block", "vec_id", "v", "least", F.explode(F.sequence(F.lit(1), F.col("to"))).alias("chunk"))
        found = found.unionByName(visit(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
