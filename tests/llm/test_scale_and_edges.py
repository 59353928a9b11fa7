"""Hot keys, moved records, large components, thresholds, clashing names: what the operators promise beyond plain rows."""

import hashlib
import itertools
import math
import os
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, fair_mixing, itq_dedup, nb_toxicity, partenum_join, pii_feistel, pu_quality, topk_search, url_rules, warc_merkle

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- helpers


def test_hot_keys_join_like_others(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id") % 900)  # a third -1, a third null
    big = common.written(spark.range(6000).select(key.alias("k"), "id"))
    small = spark.range(-1, 800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got, want = common.join_hot(big, small, "k", how), big.join(small, "k", how)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    assert {r["k"] for r in common.hot_keys(big, "k")[0].collect()} == {-1, None}


def test_components_of_structs_with_a_hot_centre(spark):
    pairs = [(0, i) for i in range(1, 1500)] + [(2000 + i, 2001 + i) for i in range(0, 6, 2)] + [(2001, 2004)]
    node = lambda c: F.struct((F.col(c) < 0).alias("none"), F.col(c).alias("id"))
    edges = spark.createDataFrame(pairs, "x long, y long").select(node("x").alias("a"), node("y").alias("b"))
    got = {r["node"]["id"]: r["component"]["id"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1500)}, 2000: 2000, 2001: 2000, 2004: 2000, 2005: 2000, 2002: 2002, 2003: 2002}


def test_scratch_deletes_what_is_not_kept(spark):
    with common.scratch() as keep:
        gone = common.written(spark.range(5))
        stays = keep(common.written(gone.filter("id > 2")))
    assert stays.count() == 2 and not os.path.isdir(gone._tidewatch_path) and os.path.isdir(stays._tidewatch_path)
    common.discard(stays)
    assert not os.path.isdir(stays._tidewatch_path)


def test_sums_over_many_partitions(spark):
    rows = spark.range(0, 3000, 1, 70)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(3)
        for b in batches:
            total += b["id"].to_numpy().sum()
        yield pa.RecordBatch.from_arrays([pa.array([4], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "x"])

    got = common.summed(rows.mapInArrow(run, "k int, x binary"), fan=4, levels=2)
    assert list(got) == [4] and got[4].tolist() == [3000 * 2999 / 2] * 3


# ---- fixity audit


def records(spark, rows):
    return spark.createDataFrame([(o, n, hashlib.sha256(t.encode()).hexdigest(), p) for o, n, t, p in rows], "offset long, length long, sha256 string, page_id long")


def test_moved_and_resized_records_are_found(spark):
    rows = [(k * 100, 100, f"r{k}", k) for k in range(200)]
    good = warc_merkle.tree(records(spark, rows), 1024, 4, ["page_id"])
    # three records change places within one range, with all hashes as before and in the same order
    moved = [(o + 3 if 10 <= p <= 12 else o, n, t, p) for o, n, t, p in rows]
    other = warc_merkle.tree(records(spark, moved), 1024, 4, ["page_id"])
    assert good.root != other.root
    found = warc_merkle.audit(good, other, ["page_id"]).collect()
    assert sorted((r["page_id"], r["offset"], r["state"]) for r in found) == sorted([(p, p * 100, "missing") for p in (10, 11, 12)] + [(p, p * 100 + 3, "extra") for p in (10, 11, 12)])
    longer = warc_merkle.tree(records(spark, [(o, n + (p == 7), t, p) for o, n, t, p in rows]), 1024, 4, ["page_id"])
    assert [(r["page_id"], r["length"], r["state"]) for r in warc_merkle.audit(good, longer, ["page_id"]).collect()] == [(7, 100, "altered")]
    # only the folders of ranges that differ are read
    one = good.leaves.at(spark.createDataFrame([(3,)], "node long"))
    assert {r["range"] for r in one.collect()} == {3} and good.leaves.df.select("shelf").distinct().count() > 1


def test_archive_with_long_bodies_and_other_columns(spark):
    rows = [(1, "http://a/", "x" * 3_000_000, 5, "r"), (2, None, None, 5, "r"), (2, None, None, 6, "r"), (None, "http://a/", "é" * 10, 5, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int, sha256 string")
    r = warc_merkle.laid_out(pages)
    got = sorted(tuple(x) for x in r.select("offset", "length").collect())
    assert [o for o, _ in got] == [0, *itertools.accumulate(n for _, n in got[:-1])] and got[-1][1] == got[-2][1]
    assert sum(n for _, n in got) > 3_000_000
    keep = warc_merkle.tree(r)
    assert warc_merkle.audit(keep, warc_merkle.tree(r)).count() == 0


# ---- url rules


def test_url_columns_may_have_any_name(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.org/xy", 7, 8, 9, "k"), (2, None, 7, 8, 9, "k")], "page_id long, url string, top int, _row int, _top int, key string")
    out = url_rules.judge(urls, rules)
    assert out.columns == ["page_id", "url", "top", "_row", "_top", "key", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r) for r in out.drop("url").collect()) == [(1, 7, 8, 9, "k", "a.org", "/xy", "a.org/x", "block"), (2, 7, 8, 9, "k", "", "", None, "allow")]


def test_very_long_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/" + "p" * 50, "block")], "host string, path string, verdict string")
    deep = "http://" + "a." * 100_000 + "org/" + "p" * 500_000
    out = url_rules.judge(spark.createDataFrame([(1, deep), (2, "http://org/"), (3, "http://a.org/" + "p" * 49)], "page_id long, url string"), rules)
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert {r["page_id"]: r["rule"] for r in out.collect()}[3] == "org/"


# ---- near-duplicate vectors


def near_pairs(rng, n, low, high, d=32):
    """n pairs of unit vectors whose cosines lie in [low, high], far from all others."""
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(n, d))
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(low, high, n)[:, None]
    return x, c * x + np.sqrt(1 - c * c) * y


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(11)
    x, y = near_pairs(rng, 1000, 0.951, 0.96)
    below = near_pairs(rng, 300, 0.93, 0.9499)
    v = np.concatenate([x, y, *below])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in itq_dedup.near_duplicates(df).collect()}
    linked = sum(got[i]["n_links"] == 1 and got[1000 + i]["component_id"] == i for i in range(1000))
    assert linked >= 900
    assert all(got[i]["n_links"] == 0 for i in range(2000, 2600))


def test_links_of_tight_groups_chains_and_copies(spark):
    rng = np.random.default_rng(12)
    centre, far = rng.normal(size=24), rng.normal(size=24)
    tight = centre + rng.normal(size=(60, 24)) * 0.05
    wide = far + rng.normal(size=(60, 24)) * 0.25
    v = np.concatenate([tight, wide, np.tile(tight[0] * 4, (30, 1)), np.tile(wide[0], (20, 1))])
    ids = rng.permutation(len(v)) + 100
    rows = [(int(i), r.tolist(), 3, 4) for i, r in zip(ids, v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, w int, name int")
    got = {r["vec_id"]: r for r in itq_dedup.near_duplicates(df).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert 0 < near[60:120, 60:120].mean() < 1  # the wide group is no clique
    links = np.array([got[int(i)]["n_links"] for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    assert (links[:60] == near[:60].sum(1)).all() and (links[120:150] == near[120:150].sum(1)).all()
    assert got[int(ids[0])]["component_id"] == min(ids[i] for i in [*range(60), *range(120, 150)])


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (3, [0.0, 2.0], 0), (None, [3.0, 0.0], 0), (None, [-1.0, 0.0], 0), (8, [-0.0, 5.0], 0)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in itq_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == sorted([("7", 1, 7, True), ("7", 2, 3, False), ("3", 2, 3, True), ("None", 1, 7, False), ("None", 0, None, True), ("8", 2, 3, False)])


# ---- exact search


@pytest.mark.parametrize("size", [1e5, 1e9, 1e25])
def test_search_is_exact_for_large_components(spark, size, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", 64)
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(400, 12)) * size)
    x[7] = x[3]
    rows = [(i, v.tolist(), 9, 9) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<double>, score int, chunk int")
    got = {}
    for r in topk_search.search(df, F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    held = lambda v, n: max(-(1 << n), min((1 << n) - (n == 63), v))
    q = [[held(math.floor(256 * c), 62) for c in v] for v in x]
    assert sorted(got) == list(range(0, 400, 40))
    for i, found in got.items():
        score = [held(sum(a * b for a, b in zip(q[i], v, strict=True)), 63) for v in q]
        best = sorted(((-score[j], j) for j in [*range(400), 5] if j != i))[:5]
        assert sorted(found) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_chunks_go_to_the_blocks_that_want_them_only(spark):
    cands = spark.createDataFrame([(c, i, bytearray(8), 1.0) for c in range(5) for i in range(10)], "chunk int, vec_id long, v binary, norm double")
    queries = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (4, 2)], "chunk int, block int")
    got = topk_search.wanted(cands, queries).groupBy("chunk", "block").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 10), (1, 2, 10), (4, 2, 10)]


# ---- pseudonyms: every kind against plain Python


def _hash(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def _letters(value, key):
    n = len(value) // 2
    a, b = value[:n], value[n:]

    def moved(half, other, i):
        out = ""
        for j, c in enumerate(half):
            first, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr(first + (ord(c) - first + _hash(key, i, j, other) % 260) % size)
        return out

    for i in range(1, pii_feistel.ROUNDS + 1):
        a, b = (moved(a, b, i), b) if i % 2 else (a, moved(b, a, i))
    return a + b


def _number(value, a, b, key):
    x, y = value // b, value % b
    for i in range(1, pii_feistel.ROUNDS + 1):
        x, y = ((x + _hash(key, i, y)) % a, y) if i % 2 else (x, (y + _hash(key, i, x)) % b)
    return x * b + y


def _luhn(digits):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))))


def plain(kind, value, key="k"):
    """The pseudonym of a value, by the definition."""
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        name, at, domain = value.partition("@")
        return _letters(name, f"{key}/email") + at + domain
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        n = _number(n, 1 << 16, 1 << 16, f"{key}/ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        day = (pd.Timestamp(value) - pd.Timestamp("1900-01-01")).days
        return str((pd.Timestamp("1900-01-01") + pd.Timedelta(days=_number(day, 17, 4297, f"{key}/date"))).date())
    if kind == "ssn":
        area, group, last = map(int, value.split("-"))
        n = _number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + last - 1, 898, 99 * 9999, f"{key}/ssn")
        area = n // (99 * 9999) + 1
        return f"{area + (area >= 666):03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    if kind == "phone":
        code = len(re.match(r"\+(1|7|\d\d)|", value)[0].lstrip("+"))
        new = digits[:code] + _letters(digits[code:], f"{key}/phone")
    else:
        body = _letters(digits[:-1], f"{key}/card")
        new = body + next(c for c in "0123456789" if _luhn(body + c) % 10 == 0)
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


VALUES = [
    ("email", "annlee7@mail.example.com"), ("ip", "10.0.255.1"), ("ip", "255.255.255.255"), ("date", "2001-02-28"), ("date", "1900-01-01"), ("date", "2099-12-31"),
    ("ssn", "123-45-6789"), ("ssn", "665-01-0001"), ("ssn", "667-99-9999"), ("ssn", "899-99-9999"), ("phone", "+1 (017) 555-7713"), ("phone", "(017) 555-7713"), ("phone", "555-771-7713"),
    ("phone", "555.771.7713"), ("phone", "+49 30 123456"), ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("card", "4111-1111-1111-1111"),
]


def test_each_kind_has_the_pseudonym_of_its_definition(spark):
    around = ["{}", "card {} 12/27, x", "order 12 {}", "+1 017 555 7713 {}", "{} 4111 1111 1111 1111", "{} 123", "(no. 7) {} 2021"]
    texts = [a.format(v) for a in around for _, v in VALUES]
    want = [[(k, plain(k, v))] for _ in around for k, v in VALUES]
    rows = [(i, t, "mine") for i, t in enumerate(texts)]
    out = pii_feistel.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, _found string"), "k").orderBy("doc_id").collect()
    for r, w, t in zip(out, want, texts, strict=True):
        if "+49" in t and not t.startswith("+49 30 123456 4111") and re.search(r"123456 \d", t):
            continue  # after +49 a further plain number cannot be told from the phone number
        assert r["_found"] == "mine" and w[0] in [tuple(p) for p in r["pii"]], t
        assert not any(v in r["text"] for _, v in VALUES if v in t), t
    assert plain("phone", "(017) 555-7713")[1:4] == plain("phone", "+1 (017) 555-7713")[4:7]


def test_ip_and_ssn_are_permuted(spark):
    ip = spark.range(0, 1 << 16).select(pii_feistel.pseudonym(F.concat(F.lit("10.1."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")), F.lit("ip"), "k").alias("x"))
    assert ip.distinct().count() == 1 << 16 and ip.filter(~F.col("x").rlike(f"^{pii_feistel.KINDS['ip']}$")).isEmpty()
    ssn = spark.range(1, 10_000).select(pii_feistel.pseudonym(F.format_string("123-45-%04d", F.col("id")), F.lit("ssn"), "k").alias("x"))
    assert ssn.distinct().count() == 9_999 and ssn.filter(~F.col("x").rlike(f"^{pii_feistel.KINDS['ssn']}$")).isEmpty()


# ---- classifiers by brute force


def test_risk_of_the_quality_model(spark):
    rng = np.random.default_rng(14)
    pos, unl = rng.normal(0.7, 1, (40, 4)), np.concatenate([rng.normal(0.7, 1, (60, 4)), rng.normal(-0.7, 1, (60, 4))])
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    pos, unl = one(pos), one(unl)
    loss = lambda z: (1 - z) ** 2 / 4
    held = 0
    for prior in (0.3, 0.5, 0.97):
        w = pu_quality.nn_pu(pos.T @ pos, unl.T @ unl, prior, 1e-2)

        def parts(w, prior=prior):
            plus = sum(loss(sum(a * b for a, b in zip(w, x, strict=True))) for x in pos) / len(pos)
            minus = sum(loss(-sum(a * b for a, b in zip(w, x, strict=True))) for x in unl) / len(unl) - prior * sum(loss(-sum(a * b for a, b in zip(w, x, strict=True))) for x in pos) / len(pos)
            return prior * plus, minus

        plus, minus = parts(w)
        assert minus == pytest.approx(pu_quality._loss(w, unl.T @ unl, -1) - prior * pu_quality._loss(w, pos.T @ pos, -1))
        assert minus >= -1e-9
        slope = lambda k, f, w=w: (f(w + 1e-5 * np.eye(5)[k]) - f(w - 1e-5 * np.eye(5)[k])) / 2e-5
        ridge = lambda w: 1e-2 / 2 * (w[:-1] ** 2).sum()
        up = np.array([slope(k, lambda v: parts(v)[0] + ridge(v)) for k in range(5)])
        down = np.array([slope(k, lambda v: parts(v)[1]) for k in range(5)])
        # the gradient of the first part plus t times that of the second is zero, t = 1 unless the second is held at zero
        t = -(up @ down) / max(down @ down, 1e-18)
        assert np.abs(up + t * down).max() < 1e-3
        if minus > 1e-6:
            assert t == pytest.approx(1, abs=1e-3)
        else:
            held += 1
            assert -1e-3 <= t <= 1 + 1e-3
    assert held


def test_sums_and_prior_of_the_quality_model(spark):
    texts = ["Plain words here.", None, "", "SHOUT!! " * 30, "a b c", "Plain words here."] * 8
    rows = [(i if i % 6 else None, t, i % 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    n = pu_quality.N_FEATURES + 1
    got = common.summed(df.select("text", "part").mapInArrow(pu_quality._sums, "k int, x binary"))[0].reshape(3, n, n)
    for k, want in enumerate(([1, 2, 3], [2], [3])):
        x = [np.append(pu_quality.features([t])[0], 1.0) for _, t, p in rows if p in want]
        assert np.allclose(got[k], sum(np.outer(v, v) for v in x))
    assert pu_quality.prior_of(np.array([0, 1, 9]), np.array([50, 4, 46])) == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize(("module", "label"), [(pu_quality, "quality"), (nb_toxicity, "toxic")])
def test_fit_on_odd_rows(spark, module, label):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinst") for _ in range(5))
    rows = [(i // 2, None if i % 17 == 0 else " ".join(word() for _ in range(30)) + (" vile scum" if i % 4 < 2 else ""), 1, 2) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "x", 1, 2)], "doc_id long, text string, y int, part int")
    marks = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(100)], f"doc_id long, {label} int").withColumn("y", F.lit("clash"))
    out = module.score(docs, module.fit(docs, marks)).collect()
    assert len(out) == 201 and all(0 <= r["score"] <= 1 for r in out)
    assert "y" in pu_quality.score(docs, pu_quality.fit(docs, marks.limit(0).withColumnRenamed(label, "quality"))).columns


def test_ratios_equal_a_dictionary_count(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abC  d\n") for _ in range(rng.randint(0, 60))) for _ in range(20)] + ["", None]
    y = [i % 3 == 0 for i in range(len(texts))]
    seen = {0: {}, 1: {}}
    for t, c in zip(texts, y, strict=True):
        s = " ".join((t or "").lower().split())
        s = f" {s} " if s else ""
        for g in {s[i : i + n] for n in nb_toxicity.SIZES for i in range(len(s) - n + 1)}:
            seen[c][g] = seen[c].get(g, 0) + 1
    rows = spark.createDataFrame(list(zip(texts, map(int, y), strict=True)), "text string, y int").mapInArrow(nb_toxicity._listed, "y int, h array<int>")
    counts = rows.select("y", F.explode("h").alias("h")).groupBy("h").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    n = {0: y.count(False), 1: y.count(True)}
    got = sorted(r["r"] for r in nb_toxicity.ratios(counts, n, -1.0).collect())
    want = sorted(math.log((seen[1].get(g, 0) + 1) / (n[1] + 2) / ((seen[0].get(g, 0) + 1) / (n[0] + 2))) for g in seen[0].keys() | seen[1].keys())
    assert got == pytest.approx(want)  # no two of these few n-grams share a hash
    assert nb_toxicity.least_chi_square(20) == pytest.approx(3.84, abs=0.01)


# ---- Jaccard join


def test_many_sets_that_share_a_passage(spark, monkeypatch):
    """More sets than are paired one by one share signatures; blocks are small, so that classes meet in many of them."""
    monkeypatch.setattr(partenum_join, "BLOCK_BYTES", 4096)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    base, other = rng.choices(words, k=120), rng.choices(words, k=120)
    texts = []
    for b in (base, other):
        for _ in range(40):
            copy = list(b)
            copy[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(base[:60] + rng.choices(words, k=60)) for _ in range(40)] + [" ".join(base)] * 30
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum_join.jaccard_components(df).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i in range(len(texts)):
        low[find(i)] = min(low.get(find(i), 10**9), len(texts) - i)
    assert got == {len(texts) - i: low[find(i)] for i in range(len(texts))}


def test_large_groups_meet_their_pivots_first(spark, monkeypatch):
    """Rows link where their numbers are 1 apart: chains, a dense crowd and strangers, more of them than a block holds."""
    monkeypatch.setattr(partenum_join, "BLOCK_SETS", 8)
    rng = random.Random(5)
    groups = {1: [*range(100, 140)], 2: [rng.choice((5, 6, 7)) for _ in range(90)] + [20, 30, 31], 3: [2 * k for k in range(30)], 4: [1, 2], 5: [9]}
    rows = [(g, g * 1000 + k, x) for g, xs in groups.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g long, by long, x long")

    def within(t):
        x, by, mine = (t[c].to_numpy() for c in ("x", "by", "mine"))
        a, b = np.nonzero((abs(x[:, None] - x[None]) <= 1) & ((mine[:, None] != mine[None]) | (t["i"][0].as_py() == t["j"][0].as_py())))
        return pa.table({"a": by[a], "b": by[b]})

    got = partenum_join.edges_of(df, "g", "by", F.lit(1), 64, within, lambda t, one: abs(t["x"].to_numpy() - one["x"][0].as_py()) <= 1)
    found = {r["node"]: r["component"] for r in common.components(got).collect()}
    want = {}
    for g, xs in groups.items():
        for k, x in enumerate(xs):
            reach, new = {x}, {x}
            while new := {y for y in xs if y not in reach and any(abs(y - z) <= 1 for z in reach)}:
                reach |= new
            low = min(j for j, y in enumerate(xs) if y in reach)
            if sum(y in reach for y in xs) > 1:
                want[g * 1000 + k] = g * 1000 + low
    assert found == want


def test_copies_of_one_template_cost_their_number(spark, monkeypatch):
    """All rows of a group link with a pivot: no pair of blocks is left to compare."""
    monkeypatch.setattr(partenum_join, "BLOCK_SETS", 8)
    df = spark.range(500).selectExpr("1L as g", "id as by", "0L as x")

    def within(t):
        raise AssertionError("nothing is open")

    got = partenum_join.edges_of(df, "g", "by", F.lit(1), 64, within, lambda t, one: np.ones(t.num_rows, bool))
    assert {(r["node"], r["component"]) for r in common.components(got).collect()} == {(k, 0) for k in range(500)}


def test_many_rows_of_one_id_and_text(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(7, text)] * 150 + [(None, text + " more words at the end")] * 100 + [(3, text + " more"), (5, "another text of some six words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in partenum_join.jaccard_rows(df).collect()}
    near = {3, 7}
    assert got >= {(k, 3) for k in near} | {(5, 5)} and partenum_join.jaccard_rows(df).count() == len(rows)


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(15)
    sets = []
    for n in (3, 40, 70, 130, 300):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in range(6):
            sets.append(np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])))
    n, sk = np.array([len(s) for s in sets]), [partenum_join.sketch(s) for s in sets]
    a, b = map(np.array, zip(*itertools.combinations(range(len(sets)), 2), strict=True))
    may = partenum_join.may_link(n[a], [sk[i] for i in a], n[b], [sk[i] for i in b], 80, 100)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    link = 100 * both >= 80 * (n[a] + n[b] - both)
    assert link.any() and may[link].all() and not may.all()


def test_two_texts_of_one_id(spark):
    a, b = "one two three four five six seven", "quite another text of some other words"
    df = spark.createDataFrame([(2, a), (4, a), (4, b), (None, b), (9, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["is_first"]) for r in partenum_join.jaccard_rows(df).collect())
    assert got == sorted([("2", 2, True), ("4", 2, False), ("4", 4, True), ("None", 4, False), ("9", 9, True)])


# ---- mixing


def test_mixing_of_very_long_texts(spark):
    rows = [(i, "w " * (60_000 if i == 3 else 50), "en", "hot" if i % 3 else "b", 0) for i in range(300)]
    got = fair_mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["size"] for r in got}[3] == 60_000 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


# ---- inputs that once failed


def test_audit_keeps_columns_of_any_name(spark):
    names = ["shelf", "range", "node", "parent", "state", "offset"]
    rows = [(i * 100, 100, hashlib.sha256(str(i).encode()).hexdigest(), *[f"{n}{i}" for n in names[:5]]) for i in range(300)]
    df = spark.createDataFrame(rows, "offset long, length long, sha256 string, shelf string, range string, node string, parent string, state string")
    other = df.filter("offset <> 700").withColumn("sha256", F.when(F.col("offset") == 900, "x").otherwise(F.col("sha256")))
    keep = ["shelf", "range", "node", "parent", "state", "offset"]
    got = warc_merkle.audit(warc_merkle.tree(df, 1000, 4, keep), warc_merkle.tree(other, 1000, 4, keep), keep)
    assert got.columns == ["offset", "length", "expected", "found", "state", "shelf", "range", "node", "parent", "_state", "_offset"]
    assert sorted((r["offset"], r["state"], r["shelf"], r["range"], r["node"], r["parent"], r["_state"], r["_offset"]) for r in got.collect()) == [
        (700, "missing", "shelf7", "range7", "node7", "parent7", "state7", 700), (900, "altered", "shelf9", "range9", "node9", "parent9", "state9", 900)
    ]


def test_vectors_of_which_few_can_link(spark):
    """Three usable vectors in 3,000 rows, a sample that the hash would miss, and none at all."""
    bad = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(*[F.lit(0.0).cast("float")] * 8)).alias("embedding"), F.lit(0).alias("label"))
    good = spark.createDataFrame([(9000, [1.0] * 8), (9001, [1.0] * 7 + [1.01]), (9002, [-1.0, 1.0] * 4)], "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    got = {r["vec_id"]: tuple(r)[1:] for r in itq_dedup.near_duplicates(bad.unionByName(good), sample=20).collect()}
    assert len(got) == 3003 and got[9000] == (1, 9000, True) and got[9001] == (1, 9000, False) and got[9002] == (0, 9002, True)
    assert all(v == (0, k, True) for k, v in got.items() if k < 9000)
    assert itq_dedup.near_duplicates(bad).filter("n_links = 0 and component_id = vec_id and kept").count() == 3000


def test_cards_in_long_runs_of_digit_groups(spark):
    """20,000 groups in one text within seconds, and the cards among them found."""
    card = "4111 1111 1111 1111"
    groups = [f"{i % 10000:04d}" for i in range(20_000)]
    text = " ".join(groups[:9_000]) + " x " + card + " y " + " ".join(groups)
    df = spark.createDataFrame([("a " + card,), (text,)], "text string").repartition(2)
    pii_feistel.pseudonymise(df.limit(1)).collect()  # plan and code once
    began = time.time()
    got = {len(r["text"]): r for r in pii_feistel.pseudonymise(df).collect()}
    assert time.time() - began < 20
    small, large = got[len(card) + 2], got[len(text)]
    assert small["text"][2:] != card and f" x {small['text'][2:]} y " in large["text"]
    assert all(len(m["pseudonym"].replace(" ", "")) in range(13, 20) for m in large["pii"])


def test_long_words_are_merged_as_the_library_does():
    import public_tokenizers
    import sentencepiece

    from tidewatch.llm import sentencepiece_bpe

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    words = ["".join(rng.choice("abcdeé日 ▁-_0123.\u0301") for _ in range(rng.randrange(65, 400))) for _ in range(60)]
    words += ["".join(rng.choice(["the", "ing", "tion", "en", "日"]) for _ in range(3000)), "a" * 20_001, "ab" * 9_000, "日本語テキスト処理" * 900, "x" * 64, "x" * 65]
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.load_vocabulary(path))
    ids, n = encoder.encode(words)
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(w, add_eos=True) for w in words]
    long = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    began = time.time()
    ids, _ = encoder.encode([long])
    assert time.time() - began < 15 and list(ids) == library.encode(long, add_eos=True)


def test_signatures_enumerate_subsets_and_lose_no_link():
    """Pairs at and above the threshold, with any part of their shingles common, share a signature; their number is bounded."""
    rng, tested = np.random.default_rng(1), 0
    bands = partenum_join.Bands.of(80, 100, 1000)
    for _ in range(1500):
        a = np.unique(rng.integers(0, 2**63, int(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 13, 20, 36, 37, 50, 90, 180, 181, 400, 900]))).astype(np.uint64))
        r, q = int(rng.integers(0, len(a) // 4 + 1)), int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[r:], rng.integers(0, 2**63, q).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        tested += 1
        common = np.sort(rng.choice(np.union1d(a, b), int(rng.integers(0, len(a) + 1)), replace=False)) if tested % 2 else np.empty(0, np.uint64)
        x, y = (partenum_join.signatures(s, common, bands) for s in (a, b))
        assert len(np.intersect1d(x, y)), (len(a), len(b), len(common))
        assert max(len(x), len(y)) <= 2 * len(a) + 80
    assert tested > 400
    # a band of small sets: three of five cells of each partition, all ten subsets
    small = np.arange(1, 21, dtype=np.uint64)
    (band, k), *_ = bands.of_set(20)
    assert bands.fine[band] == 5 and k <= partenum_join.FEW and partenum_join.SUBSETS[5, 2].shape == (10, 5)
    full, signs = partenum_join._enumerated(small, bands, band, 0, True)
    assert len(signs) == 10 * bands.coarse[band] and full <= bands.coarse[band]
