"""A corpus pipeline: documents -> kept by quality -> one of each near-duplicate group -> pseudonymised -> mixed -> token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import fair_mixing, partenum_join, pii_feistel, pu_quality, sentencepiece_bpe
from tidewatch.llm.common import discard, scratch, table, written
from tidewatch.llm.queries import PII_KEY, QUALITY_AT, SHARE, WEIGHTS, model_path


def _packed(docs: DataFrame) -> DataFrame:
    """(text, row): the other columns in a struct, where no operator's own columns can clash with them."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier rejects. Labels come from the labels table.

    Null and empty texts are scored like any other; repeated rows are judged one by one; no labels reject nothing; other
    columns stay, one named score too.
    """
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    good = pu_quality.score(_packed(docs), model).filter(F.col("score") >= QUALITY_AT)
    return good.select("row.*", "text").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id (null last), of one id's texts the one whose set
    has the smallest hash, of equal sets the text with the smallest hash.

    Rows of equal id (null included) and equal text are one document; of such rows the smallest in order of its columns
    is kept. So an id with two texts may stay twice. Documents without words are duplicates of their own id's rows only.
    Texts are shuffled once, and rows of one id and text are combined before that.
    """
    found = partenum_join.jaccard_rows(docs).filter("is_first")
    first = found.groupBy("doc_id", "component_id", "set_hash").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    none = F.lit(None).cast(docs.select(row.alias("r")).schema["r"].dataType)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), row.alias("row"), F.lit(False).alias("kept"))
    marks = first.select("doc_id", "text_hash", none.alias("row"), F.lit(True).alias("kept"))
    met = rows.unionByName(marks).groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"), F.bool_or("kept").alias("kept"))
    return met.filter("kept and row is not null").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; n_chars follows the text, null for a null text.

    Every row stays, repeated and empty ones too; other columns are kept, one named pii too.
    """
    done = pii_feistel.pseudonymise(_packed(docs.drop("n_chars")), PII_KEY).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a document is repeated as often as the mix takes it, or left out.

    Rows with the same id and text are interchangeable: the copies taken of them are copies of the smallest in order of
    its columns. Texts are shuffled once, to meet the number of their copies; null ids meet null ids. Texts without words
    are left out; an empty table gives no rows; other columns are kept.
    """
    mixed = fair_mixing.mix(docs, WEIGHTS, SHARE).filter("taken > 0")
    times = mixed.select("doc_id", "text_hash", F.lit(None).cast(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")).schema["r"].dataType).alias("row"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).alias("times"))
    met = rows.unionByName(times).groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"), F.sum("times").cast("int").alias("times"))
    return met.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix, with what they decode to as a hash. Null and empty texts have the end
    id only; repeated rows stay; columns other than doc_id, source and text are ignored.
    """
    both = sentencepiece_bpe.encode(docs.select("doc_id", "source", "text"), model_path(), decoded_col="decoded")
    return both.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("tokens", tokens)]
#: The classifier and the join are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has written for itself, and its input, go once its table is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as keep:
            after = keep(written(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = after
