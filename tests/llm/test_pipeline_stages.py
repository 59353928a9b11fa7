"""The pipeline's stages against brute force on small rows: repeats, nulls, two texts of an id, extra columns."""

import os

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewatch.llm import fair_mixing, pu_quality
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", score int, pii int, key int, row int, taken int, kept int, _found int"


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def extra(rows):
    return [(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows]


A, B = "one two three four five six seven eight nine ten", "quite another text with words of its own kind here"
ODD = [(2, A, "en", "s", 1), (4, A, "en", "s", 1), (4, B, "en", "t", 1), (7, B + " too", "en", "s", 1), (None, B, "en", "s", 1), (5, "", "en", "s", 0), (6, None, None, None, None), (6, None, None, None, None), (8, "card 4111 1111 1111 1111", "en", "s", 1)]


def test_near_duplicates_decide_row_by_row(spark):
    for parts in (1, 3):
        df = spark.createDataFrame(extra([*ODD, ODD[0], ODD[1]]), EXTRA).repartition(parts)
        out = P.near_duplicates(spark, df, SF)
        assert out.columns == df.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in out.select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect()) == sorted(
            [("2", A), ("4", B), ("5", ""), ("6", "-"), ("8", "card 4111 1111 1111 1111")]
        )
    assert P.near_duplicates(spark, spark.createDataFrame([], EXTRA), SF).count() == 0


def test_quality_keeps_rows_and_columns(spark):
    docs = table(spark, SF, "documents")
    df = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame(ODD[5:8], DOCS))
    wide = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("score", "pii", "part", "y"))])
    out = P.quality(spark, wide, SF)
    model = pu_quality.fit(wide, table(spark, SF, "labels"))
    texts = [r["text"] for r in wide.select("text").collect()]
    want = sum(pu_quality.link(pu_quality.features([t])[0] @ model.weight + model.intercept) >= 0.3 for t in texts)
    assert out.columns == wide.columns and out.count() == want
    assert P.quality(spark, wide.limit(0), SF).count() == 0


def test_personal_data_keeps_rows_and_columns(spark):
    df = spark.createDataFrame(extra(ODD), EXTRA)
    out = P.personal_data(spark, df, SF)
    assert out.columns == df.columns and out.count() == len(ODD)
    changed = [r for r in out.collect() if r["doc_id"] == 8][0]
    assert changed["text"].startswith("card ") and "4111 1111 1111 1111" not in changed["text"] and changed["n_chars"] == 24 and changed["pii"] == 2
    assert rows_of(out.drop("text", "n_chars")) == rows_of(df.drop("text", "n_chars"))
    assert P.personal_data(spark, df.limit(0), SF).count() == 0


def test_mixing_takes_copies(spark):
    df = spark.createDataFrame(extra([*ODD, ODD[1]]), EXTRA)
    out = P.mixing(spark, df, SF)
    taken = {}
    for r in fair_mixing.mix(df, P.WEIGHTS, P.SHARE).collect():
        if r["taken"]:
            taken[r["doc_id"], r["text_hash"]] = taken.get((r["doc_id"], r["text_hash"]), 0) + r["taken"] // r["size"]
    got = {}
    for r in out.select("doc_id", F.xxhash64("text").alias("h")).collect():
        got[r["doc_id"], r["h"]] = got.get((r["doc_id"], r["h"]), 0) + 1
    assert out.columns == df.columns and got == taken
    assert P.mixing(spark, df.limit(0), SF).count() == 0


def test_tokens_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame(extra(ODD), EXTRA).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    out = P.tokens(spark, df, SF)
    want = sorted((str(r[0]), [*sp.encode(r[1] or ""), sp.eos_id()]) for r in ODD)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out.collect()) == want
    assert P.tokens(spark, df.limit(0), SF).count() == 0


def test_run_leaves_nothing_but_what_its_result_reads(spark):
    from tidewatch.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    out = P.run(spark, SF)
    left = [x for x in os.listdir(shared_dir(spark)) if x not in before and x.startswith("tidewatch-")]
    assert len(left) == 1  # what the last stage reads
    assert out.count() > 0 and out.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_sha256"]
