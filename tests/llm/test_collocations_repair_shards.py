"""Collocations, conversation repair and byte shards against brute force and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import byte_sharding, collocations, conversation_repair, queries

# ---- collocations


def phrases(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        best = []
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        for g, a in often.items():
            if any(len(x) > len(g) and 100 * b >= 100 * share * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in often.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((score, a, " ".join(g), l, r))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(best[:top])]
    return sorted(out)


def prose(seed=3, docs=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ärger", "naïve", "日本", "WORD", "é\x00x"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(docs):
        text = "".join(rng.choices(vocab, weights)[0] + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "; ", "!"]) for _ in range(rng.randrange(0, 300)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + (passage if i % 3 == 0 else "")))
    return [*rows, ("en", None), ("en", ""), (None, "... ,,"), rows[0], rows[0], ("xx", "a b " * 4000)]


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in collocations.mine(spark.createDataFrame(rows, "lang string, text string").repartition(3), **how).collect())


def test_collocations_like_brute_force(spark):
    rows = prose()
    assert mined(spark, rows, least=3, top=200) == phrases(rows, 3, 0.5, 200)
    few = mined(spark, rows, least=3, top=4)
    assert few == phrases(rows, 3, 0.5, 4) and max(r[1] for r in few) == 4


def test_collocations_of_small_buffers_and_long_texts(spark, monkeypatch):
    """A text longer than a buffer is cut at the ends of pieces; one without such ends stays whole."""
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": "a b c. d e f g h i j. k"}, {"lang": "de", "text": "x" * 30 + " y"}, {"lang": "en", "text": ""}])
    got = list(collocations._buffers(iter([batch]), 12))
    assert [t for t, _, _ in got] == [b"a b c.", b" d e f g h i j.", b" k", b"x" * 30 + b" y"]
    rows = pa.RecordBatch.from_pylist([{"lang": a or "und", "text": b or ""} for a, b in prose(5, 20)])

    every = SimpleNamespace(value=np.full(4, -1, np.int64).view(np.uint64))

    def edges():
        c = Counter()
        for b in collocations._edges(iter([rows]), 0, every):
            for r in b.to_pylist():
                p = r["path"]
                for i in range(max(1, len(p) - 2)):
                    c[tuple(p[i : i + 3])] += r["n"]
        return c

    want = edges()
    monkeypatch.setattr(collocations, "BUFFER", 700)
    assert edges() == want


def test_unary_paths_travel_as_one_row():
    h = np.arange(100, 200)
    text = np.array([*range(20), 50, *range(20), 51], np.int64)
    piece = np.array([0] * 21 + [1] * 21)
    got = sorted((r["n"], r["path"]) for b in collocations._graph(text, piece, h) for r in b.to_pylist() if len(r["path"]) > 2)
    assert got == [(1, [118, 119, 150]), (1, [118, 119, 151]), (2, list(range(100, 120)))]


def test_words_with_one_hash_are_counted_anew(spark, monkeypatch):
    rows = [(a, b) for a, b in prose(7, 15) if a == "en"]
    want, tries = phrases(rows, 2, 0.5, 2000), []
    real = collocations._entries

    def one_hash(batches, seed):  # as if all words of the first seed shared a hash
        for b in real(batches, seed):
            yield b if seed else b.set_column(0, "h", pa.array([b["h"][0].as_py()] * b.num_rows))

    monkeypatch.setattr(collocations, "_entries", one_hash)
    hot = collocations._hot
    monkeypatch.setattr(collocations, "_hot", lambda t, seed, bits: tries.append(seed) or hot(t, seed, bits))
    assert mined(spark, rows, least=2) == want and tries == [1]


def test_filter_of_frequent_words(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    bits = collocations._filter_bits(spark.createDataFrame([(int(x),) for x in h], "h long"))
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000)
    assert collocations._bright(h, bits).all() and collocations._bright(others, bits).mean() < 0.01


def test_a_hot_pair_is_dealt_out(spark, monkeypatch):
    rows = [("en", " ".join(f"a b x{i * 40 + j}" for j in range(40)) + " a b c a b c.") for i in range(60)]
    texts = collocations._texts(spark.createDataFrame(rows, "lang string, text string"))
    every = spark.sparkContext.broadcast(np.full(4, -1, np.int64).view(np.uint64))
    assert len(collocations._hot(texts, 0, every)) >= 1
    assert mined(spark, rows, least=10) == phrases(rows, 10, 0.5, 2000)


def test_no_collocations(spark):
    assert mined(spark, [("en", None), (None, "")]) == [] and mined(spark, []) == []
    d = spark.createDataFrame([("en", "a b " * 12, 1, 2)], "lang string, text string, h long, word int")
    assert [tuple(r)[1:4] for r in collocations.mine(d, least=10).orderBy("rank").collect()] == [(1, "a b a", 11), (2, "b a b", 11)]


# ---- conversations

STEP = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def repaired(rows):
    """Brute force: the shortest path over (row, state) with insertions, by plain relaxation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    def relaxed(best, new):
        for q, x in new:
            if q not in best or x[:2] < best[q][:2]:
                best[q] = x
        return best

    def inserted(best):
        for _ in range(5):
            relaxed(best, [(q, (c + 2, a + "I", o + [NAMES[l] + ":"])) for p, (c, a, o) in list(best.items()) for (s, l), q in STEP.items() if s == p and l in NAMES])
        return best

    now = inserted({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for p, (c, a, o) in now.items():
            relaxed(after, [(p, (c + 3, a + "D", o))])
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                for (s, l), q in STEP.items():
                    if s == p and role[:1] == l:
                        relaxed(after, [(q, (c + cut, a + "K", [*o, f"{role}:{text}"]))])
                    elif s == p and l in NAMES:
                        relaxed(after, [(q, (c + cut + 2, a + "R", [*o, f"{NAMES[l]}:{text}"]))])
        now = inserted(after)
    cost, audit, lines = min((now[q] for q in "0A" if q in now), key=lambda x: x[:2])
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def talk(seed, n):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = lambda: rng.choice(["Yes.", "no", " \t", "", None, "Why?", "a b\n", "Ja!  ", "…", str(rng.random()) + "."])
    return [(rng.choice([None, *range(0, 2 * n)]), role(), text()) for _ in range(n)]


def test_conversations_like_brute_force(spark):
    convs = {i: talk(i, i % 14) for i in range(150)} | {None: talk(999, 9), 1000: talk(1000, 700), 1001: [(3, "user", "Hi.")] * 50, 1002: [(i, "assistant", "same.") for i in range(300)]}
    rows = [(c, *x, 7) for c, xs in convs.items() for x in xs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int").repartition(5)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.report(df, ids).collect()}
    assert got == {c: repaired(x)[0] for c, x in convs.items()}
    lines = defaultdict(list)
    for r in sorted(conversation_repair.repaired(df).collect(), key=lambda r: r["seq"]):
        assert r["seq"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: x for c, x in lines.items()} == {c: repaired(x)[1] for c, x in convs.items() if repaired(x)[1]}


def test_every_split_of_a_span_gives_its_cell():
    rng = random.Random(2)
    t = conversation_repair.TERMINALS
    for _ in range(40):
        kinds = [rng.randrange(len(t)) for _ in range(rng.randrange(2, 9))]
        whole = conversation_repair.parsed(np.array(kinds), np.array([len(kinds)]))[0]
        for k in range(1, len(kinds)):
            left, right = conversation_repair.parsed(np.array(kinds), np.array([k, len(kinds) - k]))
            assert conversation_repair.combined(left, right) == whole
    assert conversation_repair.parsed(np.array([], int), np.array([0, 0])) == [conversation_repair.EMPTY] * 2


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (None, *range(5))] + [(None, 1, None, None)]
    out = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = (" " if text is None else text), (" " if role is None else role)
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert Counter(map(tuple, out)) == Counter(want) and len(out) > 200


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation_repair.report(none).count() == 0 and conversation_repair.repaired(none).count() == 0
    ids = spark.createDataFrame([("x",), (None,), ("x",)], "conv_id string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.report(none, ids).collect()}
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ("x", None)}


# ---- shards


def placed(rows, n):
    sizes = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    sizes.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    whole, upto, out, slots = sum(s for _, s, _ in sizes), 0, [], Counter()
    for i, s, c in sizes:
        upto += s
        shard = min(n - 1, n * (2 * upto - s) // (2 * whole))
        out.append((i, s, c, shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize("n", [1, 7, 24])
def test_shards_like_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, "é" * rng.randrange(0, 400)) for i in range(500)] + [(None, "same")] * 200 + [(3, None), (4, ""), (5, "x" * 30_000), (5, "x" * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, shard int").repartition(6)
    got = [tuple(r) for r in byte_sharding.shards(df, n).collect()]
    assert Counter(got) == Counter(placed(rows, n))
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in byte_sharding.shards(df, n).collect())


def test_shards_are_balanced_and_contiguous(spark):
    got = queries.op13_byte_sharding(spark, "/root/testdata/sf0.01").toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() - size.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    ends = got.groupby("shard")["doc_id"].agg(["min", "max"])
    assert (ends["min"].iloc[1:].to_numpy() > ends["max"].iloc[:-1].to_numpy()).all()


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", i % 3, "s") for i in range(300)] + [(None, "same", None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, source string").repartition(4)
    byte_sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["doc_id", "text", "shard", "source", "slot", "_shard"]
    assert Counter((r[0], r[1], r[2], r[3]) for r in back.collect()) == Counter(rows)
    want = Counter((r[0], r[3], r[4]) for r in placed([(a, b) for a, b, _, _ in rows], 5))
    assert Counter((r["doc_id"], r["_shard"], r["slot"]) for r in back.collect()) == want


def test_no_shards(spark):
    assert byte_sharding.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
