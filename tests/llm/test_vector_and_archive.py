"""Fixity audit, near-duplicate vectors and exact search against brute force and on edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import itq_dedup, topk_search, warc_merkle
from tidewatch.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def pages(spark, n=500):
    rows = [(i, f"http://x.example/{i}", f"<p>{'body ' * (i % 40)}</p>") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (3, "http://x.example/3", rows[3][2]), (3, "http://x.example/3", rows[3][2])], "page_id long, url string, html string")


def test_audit_finds_the_damage_and_nothing_else(spark):
    p = pages(spark)
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    held = F.when(F.col("page_id") == 77, F.concat(html, F.lit("!"))).when(F.col("page_id") != 300, html).when(F.col("page_id").isNull(), html)
    r = warc_merkle.laid_out(p, held=(url, held), same=(url, html))
    whole = {x["offset"]: x for x in r.collect()}
    at = 0
    for o in sorted(whole):  # offsets follow without holes
        assert o == at
        at += whole[o]["length"]
    body = "<p></p>"
    assert whole[min(o for o, x in whole.items() if x["page_id"] == 0)]["sha256"] == hashlib.sha256(
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x.example/0\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    ).hexdigest()
    side = lambda c: warc_merkle.tree(r.filter(F.col(c).isNotNull()).select("offset", "length", F.col(c).alias("sha256")), 4096, 4)
    good, other, same = side("sha256"), side("held"), side("same")
    assert len(good.levels) > 2 and good.root == same.root != other.root
    assert warc_merkle.audit(good, same).count() == 0
    found = {whole[x["offset"]]["page_id"]: x["state"] for x in warc_merkle.audit(good, other).collect()}
    assert found == {77: "altered", 300: "missing"}
    assert {x["state"] for x in warc_merkle.audit(other, good).collect()} == {"altered", "extra"}
    # only branches that differ are read: the third of 4096-byte ranges isn't
    short = warc_merkle.tree(r.filter("offset < 20000").select("offset", "length", "sha256"), 4096, 4)
    lost = warc_merkle.audit(good, short).collect()
    assert len(lost) == sum(o >= 20000 for o in whole) and {x["state"] for x in lost} == {"missing"}


def test_empty_archive(spark):
    r = warc_merkle.laid_out(pages(spark).limit(0)).select("offset", "length", "sha256")
    t = warc_merkle.tree(r)
    assert t.root == hashlib.sha256(b"").hexdigest() and warc_merkle.audit(t, warc_merkle.tree(r)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {x for e in edges for x in e if e[0] != e[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n=1500, d=24):
    x = rng.normal(size=(n, d))
    centres = rng.normal(size=(12, d))
    for k in range(500):
        c = centres[k % 12]
        x[k] = c + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.2])
    return x * rng.uniform(0.1, 30, (n, 1))


BAD = [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [1.0] * 23 + [None], 0), (9004, [float("nan")] * 24, 0), (9005, [float("inf")] * 24, 0), (9006, [1.0, 2.0], 0), (9007, [], 0)]


def test_near_duplicate_vectors(spark):
    x = vectors(np.random.default_rng(6)).astype(np.float32)
    ids = np.random.default_rng(7).permutation(len(x))
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    got = {r["vec_id"]: r for r in itq_dedup.near_duplicates(spark.createDataFrame([*rows, *BAD, (None, x[0].tolist(), 1)], SCHEMA).filter("vec_id is not null"), sample=800).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = np.array([got[int(i)]["n_links"] for i in ids])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    for i, *_ in BAD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    alone = ids[~near.any(1)]
    assert all(got[int(i)]["component_id"] == i for i in alone)
    assert all(r["component_id"] <= r["vec_id"] for r in got.values())


def test_identical_and_no_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(5)] + [(9, [-1.0, 0.0, 0.0], 0)], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 9: (0, 9)}
    assert itq_dedup.near_duplicates(df.limit(0)).count() == 0
    assert itq_dedup.near_duplicates(spark.createDataFrame(BAD, SCHEMA)).count() == len(BAD)


@pytest.mark.parametrize("chunk", [64, 8192])
def test_search_is_exact(spark, chunk, monkeypatch):
    monkeypatch.setattr(topk_search, "CHUNK", chunk)
    monkeypatch.setattr(topk_search, "QUERIES", 16)
    x = np.round(vectors(np.random.default_rng(8), 700), 2).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *BAD, (None, x[0].tolist(), 0)], SCHEMA).repartition(5)
    got = {}
    for r in topk_search.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(x.astype(float) * 256).astype(np.int64)
    assert sorted(got) == list(range(0, 700, 10))
    for i in got:
        s = q @ q[i]
        best = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:5]
        assert sorted(got[i]) == [(k + 1, j, int(s[j])) for k, j in enumerate(best)]


def test_search_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (50, [-1.0, 0.0], 0)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 50, -65536), (50, 1, 1, -32768), (50, 2, 0, -65536)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
