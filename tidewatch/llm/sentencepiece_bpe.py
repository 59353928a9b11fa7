"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is a run of symbols (characters at first) in which the adjacent pair of the best rank, leftmost first, is
merged again and again. No piece of a whitespace-split vocabulary holds the space mark after another character, so
a text falls into words that never merge with one another: each task encodes its distinct words together, as one
flat symbol array with a word number for each symbol. A round finds every word's best pair by a segmented minimum,
merges all its leftmost non-overlapping occurrences at once and compacts the arrays; words without a pair leave.

Defined cases: a null text counts as empty; an empty text has the end id only; characters outside the vocabulary
become the byte ids of their UTF-8 form (or the unknown id if the model has no bytes). Any length is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NO_PAIR = np.int64(1) << 62
GONE = -(1 << 40)
#: Distinct words that a task keeps; beyond it the words kept are forgotten, never the text.
KEPT_WORDS = 150_000


#: Texts that a model with any of the library's normalisers would change.
PROBES = ["", "a", " a  b ", "\u00a0\u3000x", "\ufb01\uff21\u2460", "e\u0301", "A\u00c9", "\t\n\r\x00", "\u200b\ufeff"]


@dataclass
class Vocabulary:
    """What a task needs of a model: a few MB, so it may be broadcast."""

    symbol_of: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    returns: np.ndarray
    n_symbols: int
    n_pieces: int
    more_chars: dict[int, str]
    byte_ids: list[int]
    unknown: int
    end: int
    piece_flat: np.ndarray
    piece_start: np.ndarray
    piece_size: np.ndarray
    is_byte: np.ndarray
    is_hidden: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Reads pieces and scores of a SentencePiece BPE model file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if any(sp.normalize(t) != (MARK + t.replace(" ", MARK) if t else "") for t in PROBES):
        raise ValueError("this model normalises texts, or puts no space mark before them")
    names = [sp.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    ids = {names[i]: i for i in range(n) if i not in special}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("pieces of this model cross spaces")
    # characters that occur in pieces without being pieces are symbols too
    symbols = dict(ids)
    for p in ids:
        for c in p:
            symbols.setdefault(c, len(symbols) + n)
    # rank: place of the score from the best down; equal scores share one, and position decides
    levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
    rows = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
            if a is not None and b is not None:
                rows.append((a, b, levels[sp.get_score(i)], i))
    width = max(symbols.values(), default=n) + 2
    table = np.array(rows, np.int64).reshape(-1, 4)
    keys = table[:, 0] * width + table[:, 1]
    order = np.argsort(keys)
    # symbols that, once merged, take part in a pair at least as good as the merge that made them
    own = np.full(width, NO_PAIR)
    own[table[:, 3]] = table[:, 2]
    returns = np.zeros(width, bool)
    for side in (0, 1):
        returns[table[table[:, 2] <= own[table[:, side]], side]] = True
    returns &= own < NO_PAIR
    symbol_of = np.full(0x110000, -1, np.int64)
    for p, i in symbols.items():
        if len(p) == 1:
            symbol_of[ord(p)] = i
    foreign = symbol_of < 0
    symbol_of[foreign] = -1 - np.flatnonzero(foreign)
    by_byte = {bytes([int(names[i][3:5], 16)]): i for i in range(n) if sp.is_byte(i)}
    raw = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
    sizes = np.fromiter(map(len, raw), np.int64, n)
    return Vocabulary(
        symbol_of=symbol_of,
        more_chars={i: p for p, i in symbols.items() if i >= n},
        pair_keys=keys[order],
        pair_ranks=table[order, 2],
        pair_merged=table[order, 3],
        returns=returns,
        n_symbols=width,
        n_pieces=n,
        byte_ids=[by_byte[bytes([b])] for b in range(256)] if len(by_byte) == 256 else [],
        unknown=sp.unk_id(),
        end=sp.eos_id(),
        piece_flat=np.frombuffer(b"".join(raw), np.uint8),
        piece_start=np.cumsum(sizes) - sizes,
        piece_size=sizes,
        is_byte=np.array([sp.is_byte(i) for i in range(n)]),
        is_hidden=np.array([sp.is_control(i) for i in range(n)]),
    )


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each pair; NO_PAIR where there is none. Symbols under 0 are foreign characters."""
    keys = np.where((left < 0) | (right < 0), -1, left * v.n_symbols + right)
    at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
    hit = v.pair_keys[at] == keys
    return np.where(hit, v.pair_ranks[at], NO_PAIR), np.where(hit, v.pair_merged[at], -1)


def _greedy(hit: np.ndarray) -> np.ndarray:
    """Of each run of hits next to each other, every other one from its left end."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at
    starts = np.concatenate([[True], np.diff(at) > 1])
    run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


#: Words of more characters are merged by rounds that touch the places of one rank only.
LONG = 64


def _laid_out(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words' characters, and the word of each."""
    flat = v.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return flat, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after all merges, word by word, and their number for each word.

    Foreign characters are -1 - code point.
    """
    long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
    if not long.any():
        return _merge_short(v, words)
    n = np.zeros(len(words), np.int64)
    flats = []
    for chosen, merge in ((~long, _merge_short), (long, _merge_long)):
        symbols, n[chosen] = merge(v, [words[i] for i in np.flatnonzero(chosen)])
        flats.append(symbols)
    out = np.empty(n.sum(), np.int64)
    of_long = np.repeat(long, n)
    out[~of_long], out[of_long] = flats
    return out, n


def _merge_long(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """merge_words by rounds of one rank each, the least of all words' pairs: its places are kept in a list by rank, so a
    round touches its hits and their neighbours and not whole words. The time grows with the merges, not with rounds x
    length; what is merged, and in which order inside a word, is as in _merge_short.
    """
    flat, word = _laid_out(v, words)
    n = len(flat)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.append(word[1:] != word[:-1], True)
    after[last], before[np.append(True, last[:-1])[:n]] = -1, -1
    rank, merged = np.full(n, NO_PAIR), np.full(n, -1, np.int64)
    places: dict[int, list[int]] = {}
    ranks: list[int] = []

    # ranks whose merges may make a pair as good: their places are taken one by one, from the left
    single = set(v.pair_ranks[v.returns[v.pair_merged]].tolist())

    def wait(at: np.ndarray, of: np.ndarray) -> None:
        for place, r in zip(at.tolist(), of.tolist(), strict=True):
            if r in places:
                heappush(places[r], place) if r in single else places[r].append(place)
            elif r < NO_PAIR:
                places[r] = [place]
                heappush(ranks, r)

    def renew(at: np.ndarray) -> None:
        right = after[at]
        rank[at] = NO_PAIR
        inside = right >= 0
        at, right = at[inside], right[inside]
        new, symbol = _ranks(v, flat[at], flat[right])
        rank[at], merged[at] = new, symbol
        wait(at, new)

    renew(np.arange(n))
    while ranks:
        now = heappop(ranks)
        if now in single:
            mine = places[now]
            while mine and rank[mine[0]] != now:  # changed since, or merged away
                heappop(mine)
            if not mine:
                del places[now]
                continue
            heappush(ranks, now)
            take = np.array([heappop(mine)])
        else:
            at = np.array(sorted(set(places.pop(now))))
            take = at = at[rank[at] == now]
            if not len(at):
                continue
            # of pairs that overlap in a row, every other one from the left
            fresh = np.append(True, after[at[:-1]] != at[1:])
            if not fresh.all():
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                take = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[take]
        flat[take], flat[gone] = merged[take], GONE
        rank[gone] = NO_PAIR
        follows = after[gone]
        after[take] = follows
        inside = follows >= 0
        before[follows[inside]] = take[inside]
        left = before[take]
        # a left neighbour may itself be one of take
        renew(np.unique(np.concatenate([take, left[left >= 0]])))
    stays = flat != GONE
    return flat[stays], np.bincount(word[stays], minlength=len(words))


def _merge_short(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """merge_words by rounds over the whole flat array, which is compacted after each: a round for each rank of a word."""
    flat, word = _laid_out(v, words)
    # a pair at i joins symbols i and i + 1 of one word
    rank = np.full(len(flat), NO_PAIR)
    merged = np.full(len(flat), -1, np.int64)

    def renew(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at + 1 < len(flat))]
        rank[at], merged[at] = NO_PAIR, -1
        at = at[word[at] == word[at + 1]]
        rank[at], merged[at] = _ranks(v, flat[at], flat[at + 1])

    renew(np.arange(len(flat)))
    if len(flat):
        rank[-1] = NO_PAIR
    done_flat, done_word = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(flat):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        counts = np.diff(np.append(first, len(flat)))
        best = np.minimum.reduceat(rank, first)
        least = np.repeat(best, counts)
        stay = least < NO_PAIR
        if not stay.all():
            done_flat.append(flat[~stay])
            done_word.append(word[~stay])
            flat, word, rank, merged, least = flat[stay], word[stay], rank[stay], merged[stay], least[stay]
            if not len(flat):
                break
        take = _greedy(rank == least)
        # where a merge can make a pair as good as its own, only the leftmost of that word goes now
        risky = v.returns[merged[take]]
        if risky.any():
            lead = np.concatenate([[True], word[take[1:]] != word[take[:-1]]])
            bad = np.zeros(int(word[-1]) + 1, bool)
            bad[word[take[risky]]] = True
            take = take[lead | ~bad[word[take]]]
        flat[take] = merged[take]
        keep = np.ones(len(flat), bool)
        keep[take + 1] = False
        now = take - np.arange(len(take))
        flat, word, rank, merged = flat[keep], word[keep], rank[keep], merged[keep]
        renew(now - 1)
        renew(now)
        rank[-1] = NO_PAIR
    flat, word = np.concatenate(done_flat), np.concatenate(done_word)
    return flat[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts; keeps the words met so far as ranges of one flat array. Word 0 is the end id."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.array([self.v.end], np.int32)
        self.counts = np.array([1])

    def learn(self, words: list[str]) -> None:
        flats, counts = [self.flat], [self.counts]
        for k in range(0, len(words), 50_000):
            symbols, n = merge_words(self.v, words[k : k + 50_000])
            odd = np.flatnonzero((symbols < 0) | (symbols >= self.v.n_pieces))
            if len(odd):
                spelled = [self._spell(int(s)) for s in symbols[odd]]
                more = np.array([len(x) for x in spelled])
                size = np.ones(len(symbols), np.int64)
                size[odd] = more
                wide = np.repeat(symbols, size)
                wide[np.repeat(np.isin(np.arange(len(symbols)), odd), size)] = [i for x in spelled for i in x]
                n = np.bincount(np.repeat(np.repeat(np.arange(len(n)), n), size), minlength=len(n))
                symbols = wide
            flats.append(symbols.astype(np.int32))
            counts.append(n)
        self.index.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.flat, self.counts = np.concatenate(flats), np.concatenate(counts)

    def _spell(self, symbol: int) -> list[int]:
        c = chr(-1 - symbol) if symbol < 0 else self.v.more_chars[symbol]
        return [self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unknown]

    def encode(self, texts: list[str | None], add_end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and their number for each text."""
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if add_end:
            for ws in split:
                ws.append("")
        if len(self.index) > KEPT_WORDS:
            self.forget()
        words = list(chain.from_iterable(split))
        self.learn([w for w in set(words) if w not in self.index])
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        n = self.counts[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)]
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)


def decode_all(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of the ids up to each of ends: space marks become spaces, the one put before the text goes, control ids show
    nothing.

    The bytes of all pieces are laid out at once. Bytes that don't make up UTF-8 become U+FFFD one by one; a control id
    ends a run of bytes. An id outside the vocabulary raises IndexError.
    """
    if len(ids) and (ids.min() < 0 or ids.max() >= v.n_pieces):
        raise IndexError("id outside the vocabulary")
    size = v.piece_size[ids]
    past = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    raw = v.piece_flat[np.arange(past[-1]) + np.repeat(v.piece_start[ids] - past[:-1], size)].tobytes()
    hidden, byte = v.is_hidden[ids], v.is_byte[ids]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # the first id of each text that shows
    shown = np.flatnonzero(~hidden)
    first = np.searchsorted(shown, starts)
    out = []
    for a, b, f in zip(starts.tolist(), ends.tolist(), first.tolist(), strict=True):
        whole = raw[past[a] : past[b]]
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = _utf8(whole)
        # bytes may meet across a hidden id only where byte ids are next to one
        inner = np.flatnonzero(hidden[a : b - 1]) + a if b - a > 1 else ()
        if len(inner) and byte[a:b].any():
            cuts = [a, *inner.tolist(), b]
            text = "".join(_utf8(raw[past[x] : past[y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True))
        if f < len(shown) and shown[f] < b and text[:1] == " ":
            seen = ids[shown[f]]
            if not v.is_byte[seen] and seen != v.unknown:
                text = text[1:]
        out.append(text)
    return out


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """Text of one list of ids: see decode_all."""
    return decode_all(v, np.array(ids, np.int64), np.array([len(ids)]))[0]


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else "\ufffd" for c in raw.decode("utf-8", "surrogateescape"))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", add_end: bool = True, decoded_col: str | None = None) -> DataFrame:
    """df with out_col array<int>: the ids of text_col as the sentencepiece library encodes it, end id included.

    decoded_col: adds the text that the ids decode to, in the same pass. Columns of df keep their places; those named
    out_col or decoded_col are replaced. No shuffle: a map over the rows.
    """
    v = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out_col, decoded_col)])
    new = [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    schema = T.StructType([*kept.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v.value)
        for whole in batches:
            for batch in pieces(whole, text_col, 1 << 20):
                ids, lengths = encoder.encode(batch[text_col].to_pylist(), add_end)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))
                more = [column]
                if decoded_col:
                    more.append(pa.array(decode_all(v.value, ids.astype(np.int64), np.cumsum(lengths)), pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out_col, *([decoded_col] if decoded_col else [])])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text that ids_col decodes to (null ids: empty). A map over the rows."""
    v = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                n = pc.fill_null(pc.list_value_length(batch[ids_col]), 0).to_numpy()
                text = pa.array(decode_all(v.value, pc.list_flatten(batch[ids_col]).to_numpy().astype(np.int64), np.cumsum(n)), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def digests(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of documents."""
    both = encode(df.select("doc_id", "text"), model_path, decoded_col="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
