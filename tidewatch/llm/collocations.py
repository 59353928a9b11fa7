"""Phrase collocation mining on a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges the triples that join two overlapping pairs, weighted by how often they
occur inside a piece of text. Only edges are counted over the corpus; the shorter counts come from the flow through the
nodes: a pair occurs as often as its out-edges say, plus the pieces that end with it, and a word as often as the pairs
that begin with it, plus the pieces that end with it.

A task builds the graph of some megabytes of text as numpy arrays and compacts its unary paths - edges of one weight in a
row, with no other edge in or out between them - so that a path leaves the task as one row. Edges then meet by their
first node and are summed up there, and so is the node's flow. Nodes that have many different edges in a sample are
split by the last word, so that no frequent pair is whole in one task; words are summed up with map-side combine.

Words travel as 64-bit hashes of (language, word). Two words with one hash would add up their counts: a first pass over
words, which also finds the rare ones, shows it, and is made anew with another seed. No frequent phrase has a rare word, so
pieces are cut at rare words too. Which words are rare is told by a bit filter of bounded size; a rare word that it lets
through costs time only.

Defined cases: a null text has no words; a null language is `und`, one with the literal name; repeated rows count each;
texts of any length are whole (they are cut at the ends of pieces only); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes of text whose graph a task builds at once.
BUFFER = 12 << 20
_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
#: A word, to the JVM: neither blanks nor ends of pieces.
TOKEN = r"[^\x20\x09\x0A-\x0D.,;:!?]+"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
EDGES = "path array<bigint>, n bigint"
ENTRIES = "h bigint, lang string, word string, n bigint"
#: Bytes of text that each task gives to the sample in which nodes with most edges are looked for; the sample decides
#: where edges are summed up, not which.
SAMPLE = 1 << 20


def _buffers(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, list[int], list[str]]]:
    """Texts joined by line breaks into buffers of about `most` bytes: (bytes, where each text begins, its language).

    A text that is longer is cut after the last break that fits, or after the next one.
    """
    parts: list[bytes] = []
    starts: list[int] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            whole = memoryview(text.as_buffer() or b"")
            at = 0
            while at < len(whole):
                end = len(whole)
                if end - at > most:
                    found = np.flatnonzero(_CLASS[np.frombuffer(whole[at : at + most], np.uint8)] == _BREAK)
                    if len(found):
                        end = at + int(found[-1]) + 1
                    else:
                        later = np.flatnonzero(_CLASS[np.frombuffer(whole[at + most :], np.uint8)] == _BREAK)
                        end = at + most + int(later[0]) + 1 if len(later) else end
                if size and size + end - at > most:
                    yield b"\n".join(parts), starts, langs
                    parts, starts, langs, size = [], [], [], 0
                starts.append(size)
                langs.append(lang.as_py())
                parts.append(bytes(whole[at:end]))
                size += end - at + 1
                at = end
    if parts:
        yield b"\n".join(parts), starts, langs


def _words(text: bytes, starts: list[int], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(word id of each token, its piece, (language, spelling) of each word id as two arrays, spellings, language codes)."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    kind = _CLASS[raw]
    inside = kind == _WORD
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[first]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    tokens = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    names, lang_of = np.unique(np.asarray(langs, object), return_inverse=True)
    doc = np.searchsorted(np.asarray(starts), first, "right") - 1
    word, known = pd.factorize(lang_of[doc].astype(np.int64) * len(tokens.dictionary) + tokens.indices.to_numpy())
    return word, piece, names[known // max(1, len(tokens.dictionary))], tokens.dictionary, known % max(1, len(tokens.dictionary))


def _rows(flat: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    rows = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n.astype(np.int64))], names=["path", "n"])
    for i in range(0, rows.num_rows, 1 << 18):
        yield rows.slice(i, 1 << 18)


def _graph(word: np.ndarray, piece: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A buffer's graph as rows (path, n): compacted paths of edges, of three words and more, and the pairs and single
    words that end its pieces.
    """
    n, v = len(word), len(h)
    together = piece[1:] == piece[:-1]
    ends = np.append(~together, True)[:n]
    code, known = pd.factorize(word[ends])
    yield from _rows(h[known], np.ones(len(known), np.int64), np.bincount(code, minlength=len(known)))
    # a pair of neighbours begins at each position of `pairs`
    pairs = np.flatnonzero(together)
    if not len(pairs):
        return
    node = np.full(n, -1, np.int64)
    node[pairs], pair = pd.factorize(word[pairs] * v + word[pairs + 1])
    code, known = pd.factorize(node[pairs[ends[pairs + 1]]])
    flat = np.stack([h[pair[known] // v], h[pair[known] % v]], 1).ravel()
    yield from _rows(flat, np.full(len(known), 2), np.bincount(code, minlength=len(known)))
    at = pairs[~ends[pairs + 1]]
    if not len(at):
        return
    edge, known = pd.factorize(node[at] * v + word[at + 2])
    weight = np.bincount(edge, minlength=len(known))
    # edges are numbered as they first come up, so a path's edges have numbers and first places in a row
    first = at[np.flatnonzero(np.diff(np.maximum.accumulate(edge), prepend=-1))]
    out_degree, in_degree = np.bincount(node[first], minlength=len(pair)), np.bincount(node[first + 1], minlength=len(pair))
    middle = node[first[1:]]
    linked = (np.diff(first) == 1) & (weight[1:] == weight[:-1]) & (out_degree[middle] == 1) & (in_degree[middle] == 1)
    head = np.flatnonzero(np.append(True, ~linked))
    size = np.diff(np.append(head, len(first))) + 2
    begin = np.cumsum(size) - size
    flat = h[word[np.repeat(first[head] - begin, size) + np.arange(size.sum())]]
    yield from _rows(flat, size, weight[head])


def _hashes(lang: np.ndarray, spelling: pa.Array, at: np.ndarray, seed: int) -> tuple[np.ndarray, list[bytes]]:
    """Hashes and spellings of the word ids; a language's hash is the seed of its words' hashes."""
    seeds = {x: xxhash.xxh3_64_intdigest(x.encode(), seed) for x in set(lang)}
    names = spelling.take(pa.array(at)).cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[x]) for w, x in zip(names, lang, strict=True)), np.uint64, len(names)).view(np.int64), names


def _bright(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash may be that of a frequent word."""
    at = h.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _edges(batches: Iterator[pa.RecordBatch], seed: int, bits: Broadcast, sample: bool = False) -> Iterator[pa.RecordBatch]:
    buffers = islice(_buffers(batches, SAMPLE), 1) if sample else _buffers(batches, BUFFER)
    for text, starts, langs in buffers:
        word, piece, lang, spelling, at = _words(text, starts, langs)
        if len(word):
            h = _hashes(lang, spelling, at, seed)[0]
            # a rare word is in no frequent phrase, so it ends a piece
            stays = _bright(h, bits.value)[word]
            if stays.any():
                yield from _graph(word[stays], (piece + np.cumsum(~stays))[stays], h)


def _entries(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for text, starts, langs in _buffers(batches, BUFFER):
        word, _, lang, spelling, at = _words(text, starts, langs)
        if len(word):
            h, names = _hashes(lang, spelling, at, seed)
            rows = pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(lang), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.bincount(word))], names=["h", "lang", "word", "n"])
            for i in range(0, rows.num_rows, 1 << 18):
                yield rows.slice(i, 1 << 18)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")


def _grams(texts: DataFrame, seed: int, bits: Broadcast, sample: bool = False) -> DataFrame:
    """(h1, h2, h3, n): the edges of all buffers' graphs, the pairs (h3 null) and words (h2 null) that end pieces."""
    width = F.greatest(F.size("path") - 2, F.lit(1))
    parts = F.arrays_zip(*[F.slice("path", F.lit(i), width).alias(f"h{i}") for i in (1, 2, 3)])
    return texts.mapInArrow(partial(_edges, seed=seed, bits=bits, sample=sample), EDGES).select("n", F.inline(parts)).toDF("n", "h1", "h2", "h3")


def _hot(texts: DataFrame, seed: int, bits: Broadcast) -> list[int]:
    """Hashes of the nodes with more than 1/500 of the edges of a sample: fewer than 500."""
    edges = written(_grams(texts, seed, bits, True).filter("h3 is not null").select(F.xxhash64("h1", "h2").alias("node")))
    found = [r[0] for r in edges.groupBy("node").count().filter(F.col("count") > F.lit(max(64, edges.count() // 500))).collect()]
    discard(edges)
    return found


def _frequent(texts: DataFrame, least: int, seed: int) -> tuple[DataFrame, int]:
    """(h, w: lang and word) of the words that occur at least `least` times, and a seed with which no two share a hash."""
    while True:
        entry = F.struct("lang", "word")
        each = texts.mapInArrow(partial(_entries, seed=seed), ENTRIES).repartition("h").groupBy("h")
        words = written(each.agg(F.sum("n").alias("f"), F.min(entry).alias("w"), F.max(entry).alias("x")).filter(F.col("f") >= least))
        # two words with one hash, one of them frequent or both together
        if not words.filter("w <> x").limit(1).count():
            return words.select("h", "w"), seed
        discard(words)
        seed += 1


def _filter_bits(words: DataFrame) -> np.ndarray:
    """A bit for the last bits of each hash: 2 to 16 MB, whatever the number of words; more words than bits set them all."""
    n = 1 << min(27, max(24, (64 * words.count()).bit_length()))
    at = F.col("h").bitwiseAND(n - 1)
    rows = words.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    bits = np.zeros(n >> 6, np.uint64)
    for part in rows.toLocalIterator():
        bits[part["i"]] = np.uint64(part["b"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def counts(docs: DataFrame, least: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(words, grams) of docs (lang, text), what occurs at least `least` times: words (h, lang, word, f); grams
    (h1, h2, h3, f), pairs with h3 null. Both are written tables.

    A first pass looks for rare words, at which pieces are cut, as no frequent phrase has one. Edges meet at their first
    node, where they give the counts of triples and, in the same task, of the pair; what is frequent goes on with the flow
    of each first word. The edges of hot nodes are dealt out by their last word too.
    """
    texts = _texts(docs)
    names, seed = _frequent(texts, least, seed)
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(names))
    hot = _hot(texts, seed, bits)
    # never a constant, so that the column stays part of the partitioning
    cold = F.pmod("h1", F.lit(1)) - 1
    salt = F.when(F.xxhash64("h1", "h2").isin(hot) & F.col("h3").isNotNull(), F.pmod("h3", F.lit(64))).otherwise(cold) if hot else cold
    edges = _grams(texts, seed, bits).withColumn("salt", salt).repartition("h1", "h2", "salt")
    edges = edges.groupBy("h1", "h2", "h3", "salt").agg(F.sum("n").alias("f"))
    none = F.lit(None).cast("long")
    # an edge adds to its node's flow, and goes on as itself if it is frequent
    out = F.array(F.struct(none.alias("h3"), "f"), F.when(F.col("h3").isNotNull() & (F.col("f") >= least), F.struct("h3", "f")))
    nodes = edges.select("h1", "h2", "salt", F.explode(out).alias("e")).filter("e is not null").select("h1", "h2", "e.h3", "salt", "e.f")
    nodes = nodes.groupBy("h1", "h2", "salt", "h3").agg(F.sum("f").alias("f"))
    # a pair adds to its first word's flow, once, and goes on as itself if it is frequent, or a part of a hot one
    part = F.xxhash64("h1", "h2").isin(hot) if hot else F.lit(False)
    stays = F.col("h2").isNotNull() & ((F.col("f") >= least) | part)
    up = F.array(F.when(F.col("h3").isNull(), F.struct(none.alias("h2"), none.alias("h3"), "f")), F.when(stays, F.struct("h2", "h3", "f")))
    flows = nodes.select("h1", F.explode(up).alias("e")).filter("e is not null").select("h1", "e.h2", "e.h3", "e.f")
    grams = written(flows.groupBy("h1", "h2", "h3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
    words = written(grams.filter("h2 is null").select(F.col("h1").alias("h"), "f").join(names, "h").select("h", "w.lang", "w.word", "f"))
    return words, grams.filter("h2 is not null")


def mine(docs: DataFrame, least: int = 10, share: float = 0.5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 and 3 words.

    A phrase occurs a >= least times; l and r are the counts of its two parts at the cut with the lowest score
    floor(1e6 a a / (l r)), the earlier cut of two equal ones; n: words of the language. A pair inside a triple that has
    at least `share` of its count is left out. Order: score and a descending, phrase by bytes.
    """
    words, grams = counts(docs, least)
    n = _texts(docs).groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(TOKEN))).alias("n"))
    side = lambda i: words.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))
    pairs = grams.filter("h3 is null").select("h1", "h2", F.col("f").alias("a")).join(side(1), "h1").join(side(2), "h2")
    pairs = written(pairs)
    triples = grams.filter("h3 is not null").withColumnRenamed("f", "a")
    right = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("w2").alias("w3"), F.col("f2").alias("f3"))
    triples = triples.join(pairs.select("h1", "h2", "lang", "w1", "w2", "f1", F.col("a").alias("f12")), ["h1", "h2"]).join(right, ["h2", "h3"])
    longer = grams.filter("h3 is not null")
    longer = longer.select("h1", "h2", "f").unionByName(longer.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f")).groupBy("h1", "h2").agg(F.max("f").alias("inside"))
    pairs = pairs.join(longer, ["h1", "h2"], "left").filter(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * round(100 * share)))
    wide = lambda c: f"cast({c} as decimal(20, 0))"  # noqa: E731  products pass 64 bits
    score = lambda l, r: F.expr(f"(({wide('a')} * {wide('a')}) * 1000000BD) div ({wide(l)} * {wide(r)})")
    cut = lambda l, r, k: F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    both = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut("f1", "f2", 1).alias("c")).unionByName(
        triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut("f1", "f23", 1), cut("f12", "f3", 2)).alias("c"))
    )
    both = both.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each of 64 shares of a language, then the best of those
    some = both.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_nth") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


