"""Conversation structure repair by weighted CYK interval parsing.

A conversation's roles should read `(s?(ua)+)?`: an optional system row, then user and assistant in turn. The repair
grammar is in Chomsky normal form: a nonterminal (p, q) stands for rows whose repaired roles lead from state p of that
language to state q, so the binary rules are (p, q) -> (p, r) (r, q), and a row is a terminal that is kept, given another
role or deleted. A span's cell holds, for each nonterminal, the least (cost, audit), audit being the initials of the edits
in order; the terminals' cells are closed under insertion on both sides. Since the nonterminals are pairs of states, every
split of a span gives the same cell, so spans are combined bottom-up by doubling length with one split each; equal pairs
of cells are combined once. Of two derivations of one span with equal cost neither audit is a prefix of the other (the
difference would be insertions, which cost), so least audits stay least when spans are joined.

Rows are dealt out by range of (conversation, turn), without their texts. A task parses its stretch of each conversation,
and what it hands on is one cell for each, so a conversation with a third of all rows is parsed by many tasks. The texts
are shuffled once, to stream past the finished audit; a conversation's repaired rows then come out in order, whatever
their number, and a task holds one batch of them.

Defined cases: null roles and texts are one space; rows of one turn are in order of role and of the text's md5, null turns
first; a null conv_id is a conversation of its own; repeated rows are duplicates of the first; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .sweep import ranged

#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"
# states: nothing yet, after the system row, after a user row, after an assistant row
_STEPS = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
_REACHED = {"0": "0SUA", "S": "SUA", "U": "UA", "A": "UA"}
PAIRS = [p + q for p in "0SUA" for q in _REACHED[p]]
_RULES = [[(PAIRS.index(pq[0] + r), PAIRS.index(r + pq[1])) for r in "0SUA" if pq[0] + r in PAIRS and r + pq[1] in PAIRS] for pq in PAIRS]
ACCEPTED = [PAIRS.index("00"), PAIRS.index("0A")]
Cell = tuple[tuple[int, str], ...]


def combined(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two halves."""
    out = []
    for rule in _RULES:
        costs = [a[i][0] + b[j][0] for i, j in rule]
        low = min(costs)
        out.append((low, min(a[i][1] + b[j][1] for (i, j), c in zip(rule, costs, strict=True) if c == low)) if low < NEVER else (NEVER, ""))
    return tuple(out)


def _insertions() -> Cell:
    """The cell of no rows: only insertions of user and assistant."""
    cell = {pq: (0, "") if pq[0] == pq[1] else (NEVER, "") for pq in PAIRS}
    for _ in PAIRS:
        for (p, letter), q in _STEPS.items():
            for o in "0SUA":
                if letter in "ua" and o + p in cell and o + q in cell:
                    cost, audit = cell[o + p]
                    cell[o + q] = min(cell[o + q], (cost + INSERT, audit + "I")) if cost < NEVER else cell[o + q]
    return tuple(cell[pq] for pq in PAIRS)


EMPTY = _insertions()


def _terminal(initial: str, truncated: bool, deleted: bool) -> Cell:
    cell = {pq: (DELETE, "D") if pq[0] == pq[1] else (NEVER, "") for pq in PAIRS}
    if not deleted:
        for (p, letter), q in _STEPS.items():
            if letter == initial:
                cell[p + q] = min(cell[p + q], (truncated * TRUNCATED, "K"))
            elif letter in "ua":
                cell[p + q] = min(cell[p + q], (REROLE + truncated * TRUNCATED, "R"))
    return combined(combined(EMPTY, tuple(cell[pq] for pq in PAIRS)), EMPTY)


_INITIALS = "sua "
#: Cells of the nine kinds of rows: initial x truncated, and rows that must go.
TERMINALS = [_terminal(x, t, False) for x in _INITIALS for t in (False, True)] + [_terminal(" ", False, True)]
_GONE = len(TERMINALS) - 1


def parsed(kinds: np.ndarray, sizes: np.ndarray) -> list[Cell]:
    """The cell of each of the spans of `sizes` rows that follow one another in kinds (indices of TERMINALS)."""
    ids, cells, lens = kinds.astype(np.int64), TERMINALS, sizes.astype(np.int64)
    while len(lens) and lens.max() > 1:
        half = (lens + 1) // 2
        nth = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = np.repeat(np.cumsum(lens) - lens, half) + 2 * nth
        alone = 2 * nth + 1 == np.repeat(lens, half)
        right = np.where(alone, 0, ids[np.where(alone, left, left + 1)] + 1)
        pairs, ids = np.unique(ids[left] * (len(cells) + 1) + right, return_inverse=True)
        a, b = np.divmod(pairs, len(cells) + 1)
        cells = [cells[i] if j == 0 else combined(cells[i], cells[j - 1]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        lens = half
    at = np.cumsum(lens) - lens
    return [cells[ids[i]] if n else EMPTY for i, n in zip(at.tolist(), lens.tolist(), strict=True)]


def _spaceless(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def _clean(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("h"))


def _judged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, seen, blank, truncated): one for each different row of a turn, n times there; seen in
    an earlier turn or not. A conversation of ids has one more with n = 0.
    """
    trimmed = _spaceless(F.col("text"))
    marks = rows.select("conv_id", "turn", "role", "h", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"))
    each = marks.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    each = written(each)
    # texts that come up in one turn only need no look at others
    first = each.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("t"), F.count("*").alias("k")).filter("k > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), "t")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h"))
    seen = F.coalesce(F.struct("turn") > F.col("t"), F.lit(False))
    out = each.join(first, same, "left").select("conv_id", "turn", "role", "h", "n", seen.alias("seen"), "blank", "truncated")
    none = ids.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("h", "string"))], F.lit(0).cast("long").alias("n"), *[F.lit(False).alias(c) for c in ("seen", "blank", "truncated")])
    return out.unionByName(none)


_SEGMENT = [("low", "bigint"), ("high", "bigint"), ("turns", "bigint"), ("head", "string"), ("tail", "string"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("costs", "array<bigint>"), ("audits", "array<string>")]
_LEGAL = ("su", "ua", "au")


def _segments(t: pa.Table) -> pa.Table:
    """A task's rows as one row for each conversation: its cell and counts."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("conv_id", "turn", "role", "h")], null_placement="at_start")).combine_chunks()
    conv = t["conv_id"].combine_chunks()
    coded = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
    heads = np.flatnonzero(np.diff(coded, prepend=-1))
    group = np.cumsum(np.diff(coded, prepend=-1) != 0) - 1
    n = t["n"].to_numpy()
    flag = lambda c: t[c].to_numpy().astype(bool)
    blank, seen, cut = flag("blank"), flag("seen"), flag("truncated")
    letter = pc.fill_null(pc.utf8_slice_codeunits(t["role"], 0, 1), "").to_pylist()
    initial = np.fromiter((_INITIALS.find(x) if x in ("s", "u", "a") else 3 for x in letter), np.int64, len(letter))
    kind = np.where(blank | seen, _GONE, initial * 2 + cut)
    first = np.zeros(int(n.sum()), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    kinds = np.where(first, np.repeat(kind, n), _GONE)
    total = lambda x: np.bincount(group, weights=x, minlength=len(heads)).astype(np.int64)
    cells = parsed(kinds, total(n))
    present = n > 0
    at, now = np.flatnonzero(present)[:-1], np.flatnonzero(present)[1:]
    legal = np.isin(initial[at] * 4 + initial[now], [_INITIALS.index(a) * 4 + _INITIALS.index(b) for a, b in _LEGAL])
    illegal = np.maximum(n - 1, 0)
    illegal[now[(group[at] == group[now]) & ~legal]] += 1
    turn = t["turn"].combine_chunks()
    known = present & turn.is_valid().to_numpy(zero_copy_only=False)
    where = np.flatnonzero(known)
    value, g = turn.fill_null(0).to_numpy()[where], group[where]
    new = np.append(True, (value[1:] != value[:-1]) | (g[1:] != g[:-1]))[: len(where)]
    ends = lambda x: dict(zip(g[x].tolist(), value[x].tolist(), strict=True))
    low, high = ends(slice(None, None, -1)), ends(slice(None))
    turns = np.bincount(g[new], minlength=len(heads))
    here = np.flatnonzero(present)
    head = dict(zip(group[here][::-1].tolist(), initial[here][::-1].tolist(), strict=True))
    tail = dict(zip(group[here].tolist(), initial[here].tolist(), strict=True))
    spelt = lambda x: [_INITIALS[x[i]] if i in x else None for i in range(len(heads))]
    columns = {
        "conv_id": conv.take(pa.array(heads)), "pid": t["pid"].take(pa.array(heads)), "low": pa.array([low.get(i) for i in range(len(heads))], pa.int64()), "high": pa.array([high.get(i) for i in range(len(heads))], pa.int64()), "turns": turns.astype(np.int64),
        "head": pa.array(spelt(head), pa.string()), "tail": pa.array(spelt(tail), pa.string()), "blank": total(n * blank), "duplicate": total(np.where(blank, 0, np.where(seen, n, np.maximum(n - 1, 0)))),
        "truncated": total(present & cut & ~blank & ~seen), "illegal": total(illegal), "costs": pa.array([[c for c, _ in x] for x in cells], pa.list_(pa.int64())), "audits": pa.array([[a for _, a in x] for x in cells], pa.list_(pa.string())),
    }
    return pa.table(columns)


class _Conversation:
    """What is known of the conversation that streams by: first its segments, then its rows."""

    def __init__(self, conv: object) -> None:
        self.conv, self.cell, self.low, self.high, self.turns, self.tail = conv, EMPTY, None, None, 0, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.audit: str | None = None
        self.cost, self.at, self.state, self.seq = 0, 0, "0", 0

    def segment(self, s: dict) -> None:
        self.cell = combined(self.cell, tuple(zip(s["costs"], s["audits"], strict=True)))
        for c in self.counts:
            self.counts[c] += s[c]
        if s["low"] is not None:
            self.turns += s["turns"] - (self.high == s["low"])
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        if s["head"] is not None:
            self.counts["illegal"] += self.tail is not None and self.tail + s["head"] not in _LEGAL
            self.tail = s["tail"]

    def parsed(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(self.cell[i] for i in ACCEPTED)
            self.cell = EMPTY

    def _out(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        role = role if edit == "K" else "assistant" if self.state == "U" else "user"
        self.state = _STEPS[self.state, role[0]]
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        self.parsed()
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired rows that come next: those inserted before the row, and the row unless it is deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(edit, role, text)

    def report(self) -> dict:
        self.parsed()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    """(conversation, repaired row) in order, and (conversation, None) at each conversation's end."""
    now: _Conversation | None = None
    for batch in batches:
        conv, kind, seg, role, text = (batch[c] for c in ("conv_id", "kind", "segment", "role", "text"))
        for i, (c, k) in enumerate(zip(conv.to_pylist(), kind.to_pylist(), strict=True)):
            if now is None or c != now.conv:
                if now is not None:
                    yield from ((now, r) for r in now.inserted())
                    yield now, None
                now = _Conversation(c)
            if k == 0:
                now.segment(seg[i].as_py())
            else:
                yield from ((now, r) for r in now.row(role[i].as_py(), text[i].as_py()))
    if now is not None:
        yield from ((now, r) for r in now.inserted())
        yield now, None


_REPORT = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_ROWS = [("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]


def _blocks(rows: Iterator[dict], fields: list, conv: pa.DataType, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", conv), *fields])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("text") or r.get("audit") or "")
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _with_type(batches: Iterator[pa.RecordBatch], make: Callable, fields: list) -> Iterator[pa.RecordBatch]:
    for first in batches:
        yield from _blocks(make(_stream(_chain(first, batches))), fields, first.schema.field("conv_id").type)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _reports(stream: Iterator[tuple[_Conversation, tuple[str, str, str] | None]]) -> Iterator[dict]:
    digest, lines = hashlib.sha256(), 0
    for conv, row in stream:
        if row is None:
            yield {"conv_id": conv.conv, **conv.report(), "repaired_sha256": digest.hexdigest()}
            digest, lines = hashlib.sha256(), 0
        else:
            digest.update((("\n" if lines else "") + f"{row[1]}:{row[2]}").encode())
            lines += 1


def _repaired(stream: Iterator[tuple[_Conversation, tuple[str, str, str] | None]]) -> Iterator[dict]:
    for conv, row in stream:
        if row is not None:
            yield {"conv_id": conv.conv, "seq": conv.seq, "edit": row[0], "role": row[1], "text": row[2]}
            conv.seq += 1


def _streamed(rows: DataFrame, ids: DataFrame | None, make: Callable, fields: list) -> DataFrame:
    rows = _clean(rows)
    ids = rows if ids is None else ids
    parts = ranged(_judged(rows, ids), ["conv_id", "turn", "role", "h"])
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    segment = ", ".join(f"{c} {t}" for c, t in _SEGMENT)
    schema = T.StructType([conv, T.StructField("pid", T.IntegerType()), *T.StructType.fromDDL(segment).fields])
    segments = written(parts.groupBy("pid").applyInArrow(_segments, schema))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    told = segments.select("conv_id", F.lit(0).alias("kind"), "pid", none("turn", "long"), none("role", "string"), none("h", "string"), none("text", "string"), F.struct(*[c for c, _ in _SEGMENT]).alias("segment"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), none("pid", "int"), "turn", "role", "h", "text", none("segment", f"struct<{', '.join(f'{c}: {t}' for c, t in _SEGMENT)}>"))
    both = told.unionByName(texts).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    both = both.sortWithinPartitions("conv_id", "kind", "pid", "turn", "role", "h").select("conv_id", "kind", "segment", "role", "text")
    types = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    return both.mapInArrow(partial(_with_type, make=make, fields=fields), T.StructType([conv, *[T.StructField(c, types[t]) for c, t in fields]]))


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows
    (conv_id, turn, role, text), and of each conv_id of ids, which may be without rows.

    A row's first fault counts: blank, duplicate of an earlier row's role and text, truncated (its last character other
    than spaces isn't one of .!?). gaps: turns missing between the first and last; illegal: neighbouring roles that the
    grammar doesn't have; cost and audit: the cheapest edits; the hash is that of the repaired rows as lines `role:text`.
    """
    return _streamed(rows, ids, _reports, _REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, role, text): the repaired conversations, row by row from seq 0; edit is K, R or I."""
    return _streamed(rows, None, _repaired, _ROWS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults, by crc32(`conv_id:turn`) % 20: 0 goes, 1 loses its text, 2 its .!?, 3 comes twice, 4 is a user's.

    Nulls are one space, but a null turn or conv_id stays null in its own column.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(spaced("role"))
    kept = rows.withColumn("_d", kind).filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_d")
    return kept.withColumn("_twice", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_d", "_twice")
