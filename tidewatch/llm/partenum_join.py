"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets that link at similarity s have sizes within 1 : 1/s and differ in at most k = (1-s)/(1+s) (|a|+|b|) shingles.
Sizes fall into bands; a set takes part in its own band and, where a partner may lie there, in the next. In a band
the feature domain is cut by hash into first-level partitions, and each of these into a few second-level ones. A
first-level partition is bad for a pair if more than e of its shingles differ; at most k / (e + 1) can be bad. In any
other one at most e second-level partitions differ, so the pair agrees on one of the subsets that leave e of them out.
All such subsets are enumerated, and each that has shingles is one signature (the hash of its shingles, its number and
its partition). If a set has more first-level partitions in which every subset has shingles than can be bad, it shares a
signature with each partner. Small sets have subsets of 3 of 5 second-level partitions, middling ones of 2 of 3, large
ones of 1 of 2.

Shingles that very many documents have would make common signatures. They are found on a bounded sample (which steers
cost only, never the result) and kept out of the partitions. A set that has too few full partitions without them also
signs subsets of its common shingles, and, if that still isn't enough, its empty subsets; both members of a pair of such
sets do so, so no link is lost.

Equal sets are one node. Nodes that share a signature are candidates unless the parity sketches of their sets differ in
more cells than linked sets could: few nodes are paired, many are dealt out in blocks, of which a spanning forest of the
pairs left comes back. The classes so formed meet in blocks bounded by bytes, where the full sets decide link by link.
Where there are several blocks, all rows meet a few pivots first, and those that the pivots join don't meet again.

Shingles are compared as 64-bit hashes, sets as 128-bit hashes of their sorted shingles.

Defined cases: a null text or one without words has an empty set and links with nothing; a text shorter than the
shingle is one shingle; repeated rows and ids are joined row by row; null ids get the component's smallest id, or
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_hot, pieces, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
RATIO, SMALL = 1.5, 16
#: (differences at most, (second-level partitions, of which may differ)): small sets are told apart by subsets of 3 of 5
#: and of 2 of 3; large ones have many partitions anyway, and two subsets of one for each keep signatures few.
FEW = 8
SHAPES = ((FEW, (5, 2)), (40, (3, 1)), (float("inf"), (2, 1)))
#: By shape, the subsets that are enumerated, as rows of flags.
SUBSETS = {(f, e): np.array([[j in x for j in range(f)] for x in combinations(range(f), f - e)]) for _, (f, e) in SHAPES}
#: Bytes and number of sets (or sketches) in a block at most: two blocks meet in a task.
BLOCK_BYTES, BLOCK_SETS = 16 << 20, 1024
#: Rows of a larger group that all its rows meet first.
PIVOTS = 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[2])
    return h ^ (h >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = _mixed(np.frombuffer(LOWER, np.uint8).astype(np.uint64) + np.uint64(MIX[3]))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((MIX[0], pow(MIX[0], -1, 2**64))):
            _powers[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _powers


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; words stand between ASCII white space, A-Z lower-cased.

    Word hashes of all texts come from one running sum of letter hashes times powers of the place.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    power, inverse = _power_tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * power[: len(data)])])
    w = _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raw]]))
    h = np.full(max(len(w) - width + 1, 0), width, np.uint64)
    for j in range(width):
        h = (h ^ w[j : j + len(h)]) * np.uint64(MIX[0]) + np.uint64(MIX[3])
        h ^= h >> np.uint64(29)
    h = _mixed(h)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        else:
            out.append(_mixed(np.array([_short(w[a:b].tolist())], np.uint64)) if b > a else np.empty(0, np.uint64))
    return out


def _short(words: list[int]) -> int:
    """Hash of a text of fewer words than a shingle."""
    h = len(words)
    for w in words:
        h = ((h ^ w) * MIX[0] + MIX[4]) & (2**64 - 1)
        h ^= h >> 29
    return h


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in cells, at least as many cells as elements: sets differ in as many elements at least
    as their parities do in cells.
    """
    cells = 64
    while cells < len(s):
        cells *= 2
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


@dataclass
class Bands:
    """Sizes up to top[i] belong to band i; coarse[i] first-level partitions there, each of fine[i] second-level ones, of
    which apart[i] may differ.
    """

    num: int
    den: int
    top: list[int]
    coarse: list[int]
    fine: list[int]
    apart: list[int]

    @staticmethod
    def of(num: int, den: int, largest: int) -> Bands:
        top = [1]
        while top[-1] < largest * den / num + 1:
            top.append(max(int(top[-1] * RATIO), top[-1] * den // num + 1))
        limits = [(den - num) * 2 * t // (den + num) for t in top]
        shape = [next(x for most, x in SHAPES if k <= most) for k in limits]
        # a few more first-level partitions than may be bad, as some have subsets without elements
        bad = [k // (e + 1) for k, (_, e) in zip(limits, shape, strict=True)]
        return Bands(num, den, top, [x + 1 if k <= FEW else int(1.1 * x) + 3 for x, k in zip(bad, limits, strict=True)], [f for f, _ in shape], [e for _, e in shape])

    def of_set(self, n: int) -> list[tuple[int, int]]:
        """(band, k): where a set of n shingles signs, and how many shingles it can differ from a partner there."""
        i = int(np.searchsorted(self.top, n))
        most = n * self.den // self.num
        differ = lambda partner: (self.den - self.num) * (n + partner) // (self.den + self.num)
        out = [(i, differ(min(most, self.top[i])))]
        if most > self.top[i]:
            out.append((i + 1, differ(most)))
        return [(b, k) for b, k in out if k]  # sets that can't differ are equal


def _enumerated(s: np.ndarray, bands: Bands, band: int, salt: int, empty: bool) -> tuple[int, np.ndarray]:
    """(first-level partitions of which every subset has elements, signatures of subsets: all that have some, or all)."""
    fine, coarse, apart = bands.fine[band], bands.coarse[band], bands.apart[band]
    h = _mixed(s + np.uint64((salt * MIX[4] + band) & (2**64 - 1)))
    cell = ((h >> np.uint64(33)) % np.uint64(coarse * fine)).astype(np.int64)
    count = np.bincount(cell, minlength=coarse * fine).reshape(coarse, fine)
    order = np.argsort(cell, kind="stable")
    sums = np.zeros(coarse * fine, np.uint64)
    if len(s):
        at = cell[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sums[at[first]] = np.add.reduceat(_mixed(h[order] ^ np.uint64(MIX[3])), first)
    pick = SUBSETS[fine, apart]
    # a subset's signature: the sum of its cells' hashes, with its number and that of its partition
    total = (sums.reshape(coarse, 1, fine) * pick[None].astype(np.uint64)).sum(2, dtype=np.uint64)
    number = np.arange(coarse * len(pick), dtype=np.uint64).reshape(coarse, len(pick))
    sign = _mixed(total + number * np.uint64(MIX[0]) + np.uint64(band * 2 + salt))
    some = (count[:, None, :] * pick[None]).sum(2) > 0
    return int(some.all(1).sum()), sign.ravel() if empty else sign[some]


def signatures(s: np.ndarray, common: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set; common: sorted hashes of the very frequent shingles."""
    at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
    often = common[at] == s if len(common) else np.zeros(len(s), bool)
    out = []
    for band, k in bands.of_set(len(s)):
        bad = k // (bands.apart[band] + 1)
        full, signs = _enumerated(s[~often], bands, band, 0, False)
        if full <= bad:
            more, others = _enumerated(s[often], bands, band, 1, False)
            out.append(others)
            if full + more <= bad:
                signs = _enumerated(s[~often], bands, band, 0, True)[1]
        out.append(signs)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_rows(width: int):
    """Rows (doc_id, key, text) -> (doc_id, key, n, fp, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                sets = shingles(b["text"].to_pylist(), width)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], *columns], names=["doc_id", "key", "n", "fp", "sketch"])

    return run


def _common(docs: DataFrame, width: int, sample: int, part: float, total: int) -> np.ndarray:
    """Shingles that at least `part` of a hash sample of about `sample` documents have: at most 1/part times their mean number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *shingles(b["text"].to_pylist(), width)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    thin = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))
    counts = docs.select("doc_id", "text").filter(thin).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(8, int(part * min(sample, total)))
    return np.sort(np.array([r["h"] for r in counts.filter(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64))


def _signature_rows(width: int, common: object, bands: Bands):
    """Rows (text) -> (sig, node); each set signs once in a task, so copies don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                sigs, nodes = [np.empty(0, np.uint64)], []
                for s in shingles(b["text"].to_pylist(), width):
                    fp = fingerprint(s)
                    if fp is None or fp in seen:
                        continue
                    seen.add(fp)
                    sigs.append(signatures(s, common.value, bands))
                    nodes.append(np.full(len(sigs[-1]), int.from_bytes(fp[:8], "big"), np.uint64))
                flat, node = np.concatenate(sigs), np.concatenate([np.empty(0, np.uint64), *nodes])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(node.view(np.int64))], names=["sig", "node"])

    return run


def _candidates(small: int):
    """Rows sorted by (sig, node) -> (a, b, many): nodes that share a signature, each pair once a batch.

    Up to `small` nodes of a signature are paired with one another. Of a signature with more nodes, the rows (node,
    signature) come out as they are, with many = 1, so that no signature is held whole.
    """

    def paired(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[keep], node[keep]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        crowd = np.repeat(count > small, count)
        a, b = [], []
        at = np.flatnonzero(~crowd)
        for step in range(1, small):
            at = at[at + step < len(sig)]
            at = at[sig[at] == sig[at + step]]
            if not len(at):
                break
            a.append(at + step)
            b.append(at)
        pairs = np.unique(np.stack([node[np.concatenate(a)], node[np.concatenate(b)]]), axis=1) if a else np.empty((2, 0), np.int64)
        many = np.concatenate([np.zeros(pairs.shape[1], np.int64), np.ones(int(crowd.sum()), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], node[crowd]])), pa.array(np.concatenate([pairs[1], sig[crowd]])), pa.array(many)], names=["a", "b", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held, crowded = [], [], 0, None
        for x in batches:
            sig, node = x["sig"].to_numpy(), x["node"].to_numpy()
            if crowded is not None:  # the rest of a signature known to be crowded goes straight on
                rest = int(np.searchsorted(sig, crowded, "right"))
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array(node[:rest]), pa.array(sig[:rest]), pa.array(np.ones(rest, np.int64))], names=["a", "b", "many"])
                sig, node = sig[rest:], node[rest:]
                if len(sig):
                    crowded = None
            sigs.append(sig)
            nodes.append(node)
            held += len(sig)
            if held > 200_000:
                sig, node = np.concatenate(sigs), np.concatenate(nodes)
                end = int(np.searchsorted(sig, sig[-1]))  # all but the last signature are complete
                if len(np.unique(node[end:])) > small:
                    crowded, end = sig[-1], len(sig)
                if end:
                    yield paired(sig[:end], node[:end])
                sigs, nodes, held = [sig[end:]], [node[end:]], len(sig) - end
        if held:
            yield paired(np.concatenate(sigs), np.concatenate(nodes))

    return run


def may_link(n_a: np.ndarray, s_a: list[bytes], n_b: np.ndarray, s_b: list[bytes], num: int, den: int) -> np.ndarray:
    """False only for pairs of sets of these sizes and sketches that can't link; pair by pair."""
    keep = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
    width_a, width_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (s_a, s_b))
    shape = width_a << 32 | width_b
    for kind in np.unique(shape[keep]):
        at = np.flatnonzero(keep & (shape == kind))
        a, b = (np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1) for s in (s_a, s_b))
        a, b = _folded(a, b.shape[1]), _folded(b, a.shape[1])
        keep[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= (den - num) * (n_a[at] + n_b[at]) // (den + num)
    return keep


def _folded(s: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row) brought to at most `width` bytes: halves laid over one another."""
    while s.shape[1] > width:
        s = s[:, : s.shape[1] // 2] ^ s[:, s.shape[1] // 2 :]
    return s


def sketched_within(n: np.ndarray, sketches: list[bytes], num: int, den: int, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that may link, all pairs of a block being compared as a matrix.

    mine: only pairs of different values count. An edge joins two sets that a chain of such pairs joins.
    """
    near = np.zeros((len(n), len(n)), bool)
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    kinds = np.unique(width).tolist()
    at = {w: np.flatnonzero(width == w) for w in kinds}
    rows = {w: np.frombuffer(b"".join([sketches[i] for i in at[w]]), np.uint8).reshape(-1, w) for w in kinds}
    for x in kinds:
        for y in [w for w in kinds if w <= x]:
            a, b = np.ascontiguousarray(_folded(rows[x], y)).view(np.uint64), rows[y].view(np.uint64)
            step = max(1, (1 << 21) // b.size)
            for start in range(0, len(a), step):
                i, j = at[x][start : start + step], at[y]
                n_i, n_j = n[i][:, None], n[j][None]
                apart = np.bitwise_count(a[start : start + step, None] ^ b[None]).sum(2, dtype=np.int64)
                hit = (apart <= (den - num) * (n_i + n_j) // (den + num)) & (den * np.minimum(n_i, n_j) >= num * np.maximum(n_i, n_j))
                near[np.ix_(i, j)] = hit
                near[np.ix_(j, i)] = hit.T
    np.fill_diagonal(near, False)
    if mine is not None:
        near &= mine[:, None] != mine[None]
    new = near.any(1)
    a, b = [], []
    for k in np.flatnonzero(new).tolist():
        if not new[k]:
            continue
        front, reached = np.array([k]), np.zeros(len(n), bool)
        reached[k] = True
        while len(front):
            front = np.flatnonzero(near[front].any(0) & ~reached)
            reached[front] = True
        new &= ~reached
        reached[k] = False
        b.append(np.flatnonzero(reached))
        a.append(np.full(len(b[-1]), k))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))


def linked_to(one: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the sets link with one set."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    hit = (den * np.minimum(n, len(one)) >= num * np.maximum(n, len(one))) & (n > 0)
    some = np.flatnonzero(hit)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        both = np.add.reduceat(one[at] == flat, np.concatenate([[0], np.cumsum(n[some])[:-1]]), dtype=np.int64)
        hit[some] = den * both >= num * (n[some] + len(one) - both)
    return hit


def links_within(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets: from each set reached, the sets not reached yet are compared to it."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    by_size = np.argsort(n, kind="stable")
    left = [int(k) for k in by_size]
    a, b = [], []
    while left:
        front = [left.pop()]
        while front and left:
            k = front.pop()
            rest = np.array(left)
            hit = rest[linked_to(sets[k], [sets[i] for i in left], num, den)]
            if len(hit):
                gone = set(hit.tolist())
                left = [i for i in left if i not in gone]
                front.extend(hit.tolist())
                a.extend([k] * len(hit))
                b.extend(hit.tolist())
    return np.array(a, np.int64), np.array(b, np.int64)


def _main_pivots(t: pa.Table) -> pa.Table:
    """Of one group's rows (mask, n), n rows that link with the pivots in mask: the pivots (bits) of the largest class."""
    masks, n = t["mask"].to_numpy(), t["n"].to_numpy()
    low = np.arange(PIVOTS)
    for m in masks.tolist():
        bits = [k for k in range(PIVOTS) if m >> k & 1]
        low[np.isin(low, low[bits])] = low[bits].min()
    weight = np.bincount(low[[(m & -m).bit_length() - 1 for m in masks.tolist()]], n, PIVOTS)
    main = sum(1 << int(k) for k in np.flatnonzero(low == weight.argmax()))
    return pa.table({t.column_names[0]: t.column(0).slice(0, 1), "main": pa.array([main], pa.int64())})


def edges_of(rows: DataFrame, group: str, name: str, size: Column, most: int, within: object, to_one: object) -> DataFrame:
    """A written table of edges (a, b) between names such that each group's rows are joined as all links within the group join them.

    rows: a written table with the columns group (long), name and by, which tells rows apart. within: from a table of
    rows with mine, i and j, the edges of a forest of their links (for i <> j, of those between different `mine` at
    least). to_one: from a table of rows and one of a single row, which of the rows link with it.

    A group of one block (`most` of size, BLOCK_SETS rows) is one task. The rows of a larger one first meet PIVOTS of
    its rows. Those that link with pivots of one class are one component by that (the main ones, where the class is the
    largest), so of their pairs none is left to compare; only the others meet all rows, in blocks, every pair of blocks
    in a group of its own. So copies of one template cost their number, not its square. A row larger than a block is
    not split.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(size, F.lit(most // BLOCK_SETS))
    kind = rows.schema[name].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    zero = {c: F.lit(0) for c in ("mine", "i", "j")}
    big = written(rows.groupBy(group).agg(F.ceil(F.sum(size) / most).cast("int").alias("parts")).filter("parts > 1"))
    if big.isEmpty():
        discard(big)
        return written(rows.withColumns(zero).repartition(parts, group).groupBy(group).applyInArrow(within, schema))
    placed = join_hot(rows, big, group, "left")
    small = placed.filter("parts is null").drop("parts").withColumns(zero).repartition(parts, group).groupBy(group).applyInArrow(within, schema)
    large = written(placed.filter("parts is not null").withColumn("mine", F.pmod(F.xxhash64("by"), F.col("parts")).cast("int")))
    # the pivots: of PIVOTS parts of a group by hash, the least row each; every block of the group gets them
    part = F.pmod(F.xxhash64(F.lit(1), "by"), F.lit(PIVOTS)).cast("int").alias("pivot")
    pivots = large.groupBy(group, part).agg(F.min_by(F.struct(*large.columns), "by").alias("row")).select("pivot", "row.*")
    everywhere = pivots.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*large.columns, "pivot")
    meeting = large.withColumn("pivot", F.lit(None).cast("int")).unionByName(everywhere)

    def met(t: pa.Table) -> pa.Table:
        chosen, others = t.filter(pc.is_valid(t["pivot"])), t.filter(pc.is_null(t["pivot"])).drop_columns(["pivot"])
        mask, hits = np.zeros(others.num_rows, np.int64), []
        for at in range(chosen.num_rows):
            hits.append(to_one(others, chosen.slice(at, 1)))
            mask |= hits[-1].astype(np.int64) << chosen["pivot"][at].as_py()
        row, which = np.nonzero(np.stack(hits, 1)) if hits else (np.empty(0, np.int64),) * 2
        starts = pa.array(np.searchsorted(row, np.arange(others.num_rows + 1)), pa.int32())
        to = pa.ListArray.from_arrays(starts, chosen[name].combine_chunks().take(pa.array(which)))
        return others.append_column("mask", pa.array(mask)).append_column("to", to)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in large.schema)
    seen = written(meeting.repartition(parts, group, "mine").groupBy(group, "mine").applyInArrow(met, f"{names}, mask long, to array<{kind}>"))
    discard(large)
    main = seen.filter("mask <> 0").groupBy(group, "mask").agg(F.count("*").alias("n")).groupBy(group).applyInArrow(_main_pivots, f"{group} long, main long")
    done = join_hot(seen, main, group, "left").withColumn("done", F.coalesce(F.col("mask").bitwiseAND(F.col("main")) != 0, F.lit(False))).drop("main", "parts", "mine")
    done = written(done)
    discard(seen)
    blocks = lambda own: F.ceil(F.coalesce(F.sum(F.when(own, size)), F.lit(0)) / most).cast("int")
    left = written(done.groupBy(group).agg(blocks(F.col("done")).alias("sure"), blocks(~F.col("done")).alias("open")).filter("open > 0"))
    to_pivots = done.select(F.col(name).alias("a"), F.explode("to").alias("b")).filter("a <> b")
    # blocks of open rows (0, 1, ..) meet one another and the blocks of the others (-1, -2, ..)
    mine = F.when(F.col("done"), -1 - F.pmod(F.xxhash64("by"), F.greatest("sure", F.lit(1)))).otherwise(F.pmod(F.xxhash64("by"), F.col("open"))).cast("int")
    first = F.when(F.col("done"), F.lit(0)).otherwise(-F.col("sure"))
    pairs = join_hot(done, left, group).drop("mask", "to").withColumn("mine", mine)
    pairs = pairs.withColumn("other", F.explode(F.sequence(first, F.col("open") - 1))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    between = pairs.drop("other", "sure", "open", "done").repartition(parts, group, "i", "j").groupBy(group, "i", "j").applyInArrow(within, schema)
    out = written(small.unionByName(to_pivots).unionByName(between))
    discard(big, done, left)
    return out


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, sample: int = 20_000, common_part: float = 0.001) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text): see jaccard_rows."""
    return jaccard_rows(docs, num, den, width, sample, common_part).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, sample: int = 20_000, common_part: float = 0.001) -> DataFrame:
    """(doc_id, text_hash, set_hash, n_shingles, component_id, is_first) for every row of docs (doc_id, text).

    Rows link when den * |a and b| >= num * |a or b| over their shingle sets; component_id is the smallest doc_id
    reachable by links. is_first: the row has the id and the set that the component is named after (rows without words
    all have it); text_hash: xxhash64 of the text, to tell the texts of one id apart; set_hash: 128-bit hash of the set,
    null without words. sample, common_part: how the
    frequent shingles are found; they change the cost, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    known = written(rows.select("doc_id", "key", "text").mapInArrow(_set_rows(width), f"doc_id {id_type}, key long, n long, fp binary, sketch binary"))
    total, largest = known.agg(F.count("*"), F.max("n")).first()
    common = spark.sparkContext.broadcast(_common(rows, width, sample, common_part, total))
    bands = Bands.of(num, den, largest or 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a set is named after its smallest id (null last); one row of it gives the text
    member = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")
    of_sets = known.filter("fp is not null").groupBy("fp").agg(F.min(member).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    node = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    nodes = written(of_sets.select("fp", node.alias("node"), F.struct(F.col("row.none").alias("none"), F.col("row.id").alias("id"), "fp").alias("name"), F.col("row.key").alias("key"), "n", "sketch"))
    signed = rows.select("text").mapInArrow(_signature_rows(width, common, bands), "sig long, node long")
    pairs = written(signed.repartition(parts, "sig").sortWithinPartitions("sig", "node").mapInArrow(_candidates(SMALL), "a long, b long, many long").distinct())
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    # pairs whose sketches rule a link out go; what is left doesn't chain strangers together
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n_a, n_b = x["n_a"].to_numpy(), x["n_b"].to_numpy()
            keep = pa.array(may_link(n_a, x["s_a"].to_pylist(), n_b, x["s_b"].to_pylist(), num, den))
            yield pa.RecordBatch.from_arrays([x["a"].filter(keep), x["b"].filter(keep)], names=["a", "b"])

    def forest(t: pa.Table) -> pa.Table:
        at = np.unique(t["by"].to_numpy(), return_index=True)[1]
        name, n, mine = (t[c].to_numpy()[at] for c in ("by", "n_by", "mine"))
        between = mine if t["i"][0].as_py() != t["j"][0].as_py() else None
        a, b = sketched_within(n, t["s_by"].take(pa.array(at)).to_pylist(), num, den, between)
        return pa.table({"a": name[a], "b": name[b]})

    few = pairs.filter("many = 0").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(possible, "a long, b long")
    crowds = written(pairs.filter("many = 1").select(F.col("a").alias("by"), F.col("b").alias("sig")).join(side("by"), "by"))

    def may_link_one(t: pa.Table, one: pa.Table) -> np.ndarray:
        n, s = one["n_by"].to_numpy(), one["s_by"].to_pylist()
        return may_link(t["n_by"].to_numpy(), t["s_by"].to_pylist(), np.repeat(n, t.num_rows), s * t.num_rows, num, den)

    crowded = edges_of(crowds, "sig", "by", F.length("s_by") + 64, BLOCK_BYTES, forest, may_link_one)
    classes = components(few.unionByName(crowded))
    discard(pairs, crowds, crowded)
    wanted = nodes.join(classes, "node").select(F.col("name.id").alias("_id"), F.col("key").alias("_key"), F.col("fp").alias("_fp"), "name", F.col("component").alias("cls"))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # an id and text that hold more than 1/500 of the rows (fewer than 500 of them) are looked up, not shuffled
    again = known.filter("fp is not null").groupBy("doc_id", "key").count().filter(F.col("count") > F.lit(max(64, total // 500))).select("doc_id", "key").collect()
    if again:
        many = F.broadcast(spark.createDataFrame([tuple(r) for r in again], known.select("doc_id", "key").schema).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
        looked = F.broadcast(wanted.join(many.select(F.col("_id").alias("_i"), F.col("_key").alias("_k")), (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi"))
        text = rows.join(many, same, "left_anti").join(wanted, same).unionByName(rows.join(looked, same))
    else:
        text = rows.join(wanted, same)
    text = text.select("cls", "name", "_fp", "text")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows bring a set once for each task
        for whole in batches:
            fresh = []
            for fp in whole["_fp"].to_pylist():
                fresh.append(fp not in seen)
                seen.add(fp)
            for b in pieces(whole.filter(pa.array(fresh, pa.bool_())), "text", 1 << 19):
                sets = shingles(b["text"].to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b["cls"], b["name"], b["_fp"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "name", "by", "s"])

    name_type = nodes.schema["name"].dataType.simpleString()
    sets = written(text.mapInArrow(as_sets, f"cls long, name {name_type}, by binary, s binary"))
    as_hashes = lambda column: [np.frombuffer(x.as_buffer(), np.uint64) for x in column]

    def links_one(t: pa.Table, one: pa.Table) -> np.ndarray:
        return linked_to(as_hashes(one["s"])[0], as_hashes(t["s"]), num, den)

    def compared(t: pa.Table) -> pa.Table:
        # a set may come from more than one task
        at = list({fp: k for k, fp in enumerate(t["by"].to_pylist())}.values())
        a, b = links_within(as_hashes(t["s"].take(pa.array(at))), num, den)
        names = t["name"].take(pa.array(at)).combine_chunks()
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b))})

    links = edges_of(sets, "cls", "name", F.length("s") + 64, BLOCK_BYTES, compared, links_one)
    discard(sets)
    # the smallest name of a component holds its smallest id; a set that links with no other one is its own component
    joined = components(links).select(F.col("node.fp").alias("fp"), "component")
    discard(links)
    label = nodes.select("fp", "name").join(joined, "fp", "left").select("fp", F.coalesce("component", "name").alias("component"))
    id_of, first = F.col("component.id"), F.col("doc_id").eqNullSafe(F.col("component.id")) & (F.col("fp") == F.col("component.fp"))
    empty = known.filter("fp is null").select("doc_id", F.col("key").alias("text_hash"), F.col("fp").alias("set_hash"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    full = join_hot(known.filter("fp is not null").drop("sketch"), label, "fp", "left")
    return full.select("doc_id", F.col("key").alias("text_hash"), F.col("fp").alias("set_hash"), F.col("n").alias("n_shingles"), id_of.alias("component_id"), first.alias("is_first")).unionByName(empty)
