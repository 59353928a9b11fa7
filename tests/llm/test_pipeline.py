"""The pipeline's stages on the smallest tables and on odd rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewatch.llm.common import table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, written(stage(spark, docs, SF))
        kept[name] = (before.toPandas(), docs.toPandas())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    first, good = kept["quality"]
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id")["quality"]
    gone = set(first["doc_id"]) - set(good["doc_id"])
    known = [labels[i] for i in gone if i in labels.index]
    assert gone and sum(known) <= 0.1 * max(1, len(known))
    clean = [i for i in first["doc_id"] if labels.get(i) == 1]
    assert len(set(clean) - gone) >= 0.97 * len(clean)
    before, unique = kept["near_duplicates"]
    assert not unique["doc_id"].duplicated().any() and not unique[unique["text"] != ""]["text"].duplicated().any()
    assert set(unique["doc_id"]) <= set(before["doc_id"]) and before["text"].nunique() >= len(unique) >= 0.5 * before["text"].nunique()
    plain, private = kept["personal_data"]
    assert len(plain) == len(private) and (plain.set_index("doc_id")["text"].str.len() == private.set_index("doc_id")["text"].str.len()).mean() > 0.95
    mixed = kept["mixing"][1]
    assert set(mixed["doc_id"]) <= set(private["doc_id"]) and mixed["doc_id"].value_counts().max() <= 2
    tokens = kept["tokens"][1]
    assert len(tokens) == len(mixed) and (tokens["n_tokens"] == tokens["ids"].map(len)).all()
    assert P.run(spark, SF).count() == len(tokens)


def test_odd_rows_pass_through(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "Plain words stand here in a row of some length.", "en", "s", 10), (2, "Plain words stand here in a row of some length.", "en", "s", 10), (3, "w " * 50_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            frame = written(stage(spark, frame, SF).drop("ids"))
            assert frame.count() <= 12
            if "text" not in frame.columns:
                break


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (9, "quite another text with words of its own kind", "en", "s", 1), (None, text, "en", "s", 1)]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, table(spark, SF, "documents").schema), SF)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["3", "9"]  # the row without id is a copy too
    assert out.filter(F.col("doc_id") == 3).count() == 1
