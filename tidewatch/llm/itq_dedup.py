"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and reranking by the originals.

Fit (on a bounded sample): centre the unit vectors, turn them to principal axes, then learn the rotation that brings
them closest to the corners of a cube. Signs of the rotated vectors are balanced binary codes; every row gets one.
Equal unit vectors are one node with a count from then on. Retrieval: a code is cut into tables of TABLE_BITS bits.
Codes whose bits in some table differ in one place at most share a key (the table's bits with that place masked), so all
are found by one sort of keys; pairs within `radius` bits over the whole code become candidates. Each key's candidates
are kept as the star of its connected codes, not as pairs. Rerank: nodes whose codes are connected are a class, and
the original vectors decide in double precision.

In a class, the angle to a pivot saves most comparisons: nodes within half the threshold's angle of it (the core) are
all linked to one another, which takes one sum. Only nodes outside the core meet the class, and only in blocks: a class
and a key shared by many codes are cut into blocks, every pair of blocks is a group of its own. No link found is below
the threshold; pairs that no chain of close codes joins can be missed (recall on the test tables: see the README).

Defined cases: null or zero vectors, null or non-finite components and vectors of another length than most link with
nothing; identical vectors link. Every row is a vector of its own: rows with equal ids link like others and may lie in
different components; rows with null ids link too, and have component_id null if no id is reachable. kept is true where
component_id is the row's own id, or null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, written
from .vectors import block, packed, unpacked

TABLE_BITS, KEY_BLOCK, ROW_BLOCK = 16, 4096, 1024


def itq(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of (x - mean) @ projection are the codes of unit vectors x."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:bits].T
    y = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ vt).T
    return mean, axes @ r


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    x, ok = block(column, d)
    # scaled first, so that very small and very large vectors keep their direction
    x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    n = np.sqrt((x * x).sum(1))
    ok &= n > 0
    # + 0.0: no negative zeros, so that equal vectors have equal bytes
    return x / np.where(n > 0, n, 1)[:, None] + 0.0, ok


def _keys(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every (key, code): for each table and place, the table's bits with that place masked."""
    keys = []
    for t, low in enumerate(range(0, bits, TABLE_BITS)):
        width = min(TABLE_BITS, bits - low)
        part = (codes >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for j in range(width):
            keys.append((np.uint64(t * TABLE_BITS + j) << np.uint64(TABLE_BITS)) | (part & ~np.uint64(1 << j)))
    if not keys:  # codes of no bits are one code
        return np.empty(0, np.uint64), codes[:0]
    return np.concatenate(keys), np.tile(codes, len(keys))


def _star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable number for each of n nodes under the links a-b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _linked_codes(radius: int):
    """From rows sorted by (key, part): (a, b), the star of each key's codes within radius of one another."""

    def star(code: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        a, b, step = [], [], 1
        at = np.arange(len(key))
        while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
            near = at[np.bitwise_count(code[at] ^ code[at + step]) <= radius]
            a.append(near)
            b.append(near + step)
            step += 1
        a, b = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b))
        low = _star(len(key), a, b)
        own = np.flatnonzero(low < np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(code[own].view(np.int64)), pa.array(code[low[own]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, key = np.empty(0, np.uint64), np.empty((0,), np.int64)
        for x in batches:
            code = np.concatenate([code, x["code"].to_numpy().view(np.uint64)])
            key = np.concatenate([key, x["key"].to_numpy()])
            if len(key) > 50_000:  # all but the last key is complete
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield star(code[:end], key[:end])
                    code, key = code[end:], key[end:]
        if len(key):
            yield star(code, key)

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, radius: int = 12, sample: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df (vec_id, embedding).

    n_links: other rows whose cosine was found to be >= threshold. component_id: smallest vec_id reachable by links.
    sample: about how many rows, by hash, the rotation is learnt from; twice as many at most.
    """
    rows = df.select("vec_id", "embedding")
    sizes = rows.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes and sizes["d"] else 1
    bits = min(64, d)
    # vectors that can link at all: the sample is of these, however few they are
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = rows.filter((F.size("embedding") == d) & finite & F.exists("embedding", lambda x: x != 0))
    total = max(1, usable.count())
    thin = F.pmod(F.xxhash64(F.lit(1), "vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _unit(b["embedding"], d)
            yield pa.RecordBatch.from_arrays([packed(x[ok])], names=["v"])

    def learnt_from(some: DataFrame) -> np.ndarray:
        got = b"".join(bytes(r["v"]) for r in some.limit(2 * sample).mapInArrow(units, "v binary").toLocalIterator())
        return np.frombuffer(got, float).reshape(-1, d)

    x = learnt_from(usable.filter(thin))
    x = x if len(x) else learnt_from(usable)  # by chance the hash chose none of a few
    bits = min(bits, len(x))
    mean, projection = itq(x, bits) if bits else (np.zeros(d), np.zeros((d, 0)))
    bits = projection.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _unit(b["embedding"], d)
            sign = (x - mean) @ projection >= 0
            code = np.zeros(len(x), np.uint64)
            for j in range(bits):
                code |= sign[:, j].astype(np.uint64) << np.uint64(j)
            names = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary(), mask=~ok)
            yield pa.RecordBatch.from_arrays([b["vec_id"], names, packed(x), pa.array(code.view(np.int64), mask=~ok)], names=["vec_id", "fp", "v", "code"])

    codes = written(rows.mapInArrow(coded, "vec_id long, fp binary, v binary, code long"))
    # a node: equal vectors; its name orders nodes by their smallest id, null last
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))).alias("least")
    nodes = codes.filter("fp is not null").groupBy("fp").agg(least, F.count("*").alias("w"), F.first("code").alias("code"), F.first("v").alias("v"))
    nodes = written(nodes.select(F.struct("least.none", "least.id", "fp").alias("name"), "w", "code", "v"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, code = _keys(b["code"].to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(code.view(np.int64))], names=["key", "code"])

    keys = nodes.select("code").distinct().mapInArrow(keyed, "key long, code long")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = written(keys.groupBy("key").count().filter(F.col("count") > KEY_BLOCK).select("key", F.ceil(F.col("count") / KEY_BLOCK).cast("int").alias("parts")))
    if hot.isEmpty():
        dealt = keys
    else:  # a hot key's codes in blocks, each pair of blocks under a key of its own
        mine = F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("key", F.least(k, mine), F.greatest(k, mine)))
        dealt = keys.join(hot, "key", "left").withColumn("key", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pair))).select("key", "code")
    links = dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked_codes(radius), "a long, b long")
    classes = components(links).withColumnRenamed("node", "code")
    # nodes with equal codes are one class even where no other code is near
    placed = written(join_hot(nodes, classes, "code", "left").select(F.coalesce("component", "code").alias("cls"), "name", "w", "v"))
    discard(hot, classes)
    several = placed.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(join_hot(placed, several, "cls"))
    discard(placed)
    found = _reranked(members, d, threshold)
    discard(members)
    edges = found.filter("to is not null").select(F.col("name").alias("a"), F.col("to").alias("b"))
    comp = components(edges).select(F.col("node.fp").alias("fp"), "component")
    counts = found.groupBy("name.fp").agg(F.sum("n").alias("n"))
    label = nodes.select("name.fp", "name", "w").join(counts, "fp", "left").join(comp, "fp", "left")
    label = label.select("fp", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "name").alias("component"))
    out = join_hot(codes.select("vec_id", "fp"), label, "fp", "left")
    reached = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component.id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), reached.alias("component_id"), F.coalesce(F.col("vec_id") == reached, reached.isNull()).alias("kept"))


def _reranked(members: DataFrame, d: int, threshold: float) -> DataFrame:
    """(name, to, n) from members (cls, n, name, w, v): n rows found to link with a node by one group, and `to`, one
    of them or null where that's the node itself. A node has a row for each group that found something.
    """
    widest = float(np.arccos(min(1.0, max(-1.0, threshold))))

    # the pivot is the mean of up to 32 nodes of a class; it steers the cost only
    def middle(t: pa.Table) -> pa.Table:
        m = unpacked(t["v"].combine_chunks(), float, d).sum(0)
        return pa.table({"cls": t["cls"].slice(0, 1), "pivot": packed((m / max(np.sqrt(m @ m), 1e-300))[None])})

    some = members.groupBy("cls", F.pmod(F.xxhash64("name"), F.lit(32)).alias("k")).agg(F.min_by("v", "name").alias("v")).select("cls", "v")
    pivots = some.groupBy("cls").applyInArrow(middle, "cls long, pivot binary")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = unpacked(b["v"], float, d), unpacked(b["pivot"], float, d)
            angle = np.arccos(np.clip((x * p).sum(1), -1, 1))
            # well inside: rounding can't take such a pair below the threshold
            yield pa.RecordBatch.from_arrays([b["cls"], b["name"], b["w"], b["v"], pa.array(angle <= widest / 2 - 1e-6)], names=["cls", "name", "w", "v", "core"])

    name_type = members.schema["name"].dataType.simpleString()
    rows = written(join_hot(members, pivots, "cls").mapInArrow(turned, f"cls long, name {name_type}, w long, v binary, core boolean"))
    core = F.col("core")
    classes = rows.groupBy("cls").agg(
        F.sum(F.when(core, F.col("w"))).alias("cw"), F.min(F.when(core, F.col("name"))).alias("first"),
        F.ceil(F.count_if(core) / ROW_BLOCK).cast("int").alias("cores"), F.ceil(F.count_if(~core) / ROW_BLOCK).cast("int").alias("others"),
    )
    classed = written(join_hot(rows, classes, "cls"))
    discard(rows)
    within = classed.filter(core & (F.col("cw") > F.col("w"))).select("name", F.when(F.col("name") != F.col("first"), F.col("first")).alias("to"), (F.col("cw") - F.col("w")).alias("n"))
    # blocks of nodes outside the core (i) meet one another (j >= i) and the blocks of the core (j < 0)
    here = F.when(core, -1 - F.pmod(F.xxhash64("name"), F.greatest("cores", F.lit(1)))).otherwise(F.pmod(F.xxhash64("name"), F.greatest("others", F.lit(1)))).cast("int")
    outer = F.sequence(F.lit(0), F.col("others") - 1)
    with_core = F.when(F.col("cores") > 0, F.transform(F.sequence(F.lit(1), F.col("cores")), lambda k: F.struct(F.col("mine").alias("i"), (-k).alias("j")))).otherwise(F.array())
    meets = F.when(core, F.transform(outer, lambda k: F.struct(k.alias("i"), F.col("mine").alias("j")))).otherwise(
        F.concat(F.transform(outer, lambda k: F.struct(F.least(k, "mine").alias("i"), F.greatest(k, "mine").alias("j"))), with_core)
    )
    blocks = classed.filter("others > 0").withColumn("mine", here).withColumn("at", F.explode(meets)).select("cls", "at.i", "at.j", "mine", "name", "w", "v")

    def compared(t: pa.Table) -> pa.Table:
        x, w, mine = unpacked(t["v"].combine_chunks(), float, d), t["w"].to_numpy(), t["mine"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        a = np.flatnonzero(mine == i)
        b = a if i == j else np.flatnonzero(mine == j)
        near = (x[a] @ x[b].T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        count = np.zeros(len(x), np.int64)
        count[a] += near @ w[b]
        if i != j:
            count[b] += near.T @ w[a]
        p, q = np.nonzero(near)
        low = _star(len(x), a[p], b[q])
        linked = np.flatnonzero(count)
        names = t["name"].combine_chunks()
        to = names.take(pa.array(low[linked], mask=low[linked] == linked))
        return pa.table({"name": names.take(pa.array(linked)), "to": to, "n": count[linked]})

    met = blocks.groupBy("cls", "i", "j").applyInArrow(compared, f"name {name_type}, to {name_type}, n long")
    out = written(within.unionByName(met))
    discard(classed)
    return out
