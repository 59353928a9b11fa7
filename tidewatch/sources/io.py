"""Reading and writing: per-subject signal files, marks, the bronze table, window arrays, gold exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import delete, new_path

SIGNAL_FILE = "timestamp double, value double"
SAMPLES = T.StructType(
    [T.StructField("timestamp", T.DoubleType()), T.StructField("user_id", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("activity", "label", "event_phase")]
    + [T.StructField(c, T.DoubleType()) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z", "heart_rate", "spo2", "skin_temp")]
    + [T.StructField("session_id", T.StringType()), T.StructField("has_event", T.BooleanType())]
)
BRONZE_KEY = ("subject_id", "signal_name", "timestamp")
BUCKETS = 32


def _named(pattern: str, group: int) -> Column:
    """Part of the name S<id>_<what>.csv, which is that of the file or of a folder of its parts."""
    end = F.concat(F.lit("/"), F.substring_index(F.col("_metadata.file_path"), "/", -2))  # a row at a time, so not the whole path
    return F.regexp_extract(end, pattern, group)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The long table (subject_id, signal_name, timestamp, value, _source_file) of files S<id>_<signal>.csv; NaN is null."""
    name = r"[/=]S(\d+)_([^/]+)\.csv(?:/[^/]*)?$"
    rows = spark.read.schema(SIGNAL_FILE).option("header", True).csv(path)
    return rows.select(
        _named(name, 1).cast("int").alias("subject_id"), _named(name, 2).alias("signal_name"), "timestamp", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.col("_metadata.file_name").alias("_source_file")
    )


def read_marks(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(subject_id, <column>) of files S<id>_<mark>.csv with one time a row; column: loc_ts, roc_ts or onset_ts."""
    rows = spark.read.schema("timestamp double").option("header", True).csv(path)
    return rows.select(_named(r"[/=]S(\d+)_[^/]+\.csv(?:/[^/]*)?$", 1).cast("int").alias("subject_id"), F.col("timestamp").alias(column))


def with_ingest_meta(df: DataFrame, at: str, source: Column | None = None) -> DataFrame:
    """Adds _ingested_at and, given a source column, _source_file."""
    out = df.withColumn("_ingested_at", F.lit(at).cast("timestamp"))
    return out if source is None else out.withColumn("_source_file", source)


def new_rows(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of df whose key the bronze table lacks; of repeated keys within df the first by source file and value stays."""
    return _lacking(_one_each(df), known)


def _one_each(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in BRONZE_KEY]
    one = df.groupBy(*BRONZE_KEY).agg(F.min(F.struct(*sorted(rest))).alias("_r")).select(*BRONZE_KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return one.select(df.columns)


def _lacking(one: DataFrame, known: DataFrame) -> DataFrame:
    return one.join(known.select(*BRONZE_KEY), list(BRONZE_KEY), "left_anti").select(one.columns)


def append_bronze(df: DataFrame, path: str, tries: int = 20) -> DataFrame:
    """Appends the rows that are new to the table at path, in folders of subjects and signals, and returns the table.

    A folder holds the subjects and signals of one of BUCKETS hashes, in order, so that the number of files follows the
    bytes and not the subjects; a reader of one subject finds its rows by the files' statistics.

    Rows are staged under path/_data and become part of the table by one atomic step, the making of the next numbered
    file under path/_commits, which lists the data folders. A writer that finds the number taken starts again from the
    newer table, so appends at the same time add each key once; a writer that fails leaves the table as it was, and a
    replay adds nothing. Only the folders that df touches are compared. Files are cut by size. df is read once: where
    there is a table to compare with, its rows, one for each key, are written for the time of the append.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.col("subject_id").cast("long"), "signal_name"), F.lit(BUCKETS)).cast("int")
    one, staged = _one_each(df), None
    try:
        for _ in range(tries):
            version, names = _latest(spark, path)
            if names and not staged:
                staged = new_path(spark, "staged")
                one.write.parquet(staged)
                one = spark.read.schema(one.schema).parquet(staged)
            fresh = _lacking(one, _folders(spark, path, names).join(one.select(bucket.alias("key_bucket")).distinct(), "key_bucket", "left_semi")) if names else one
            name = f"_commit=c{uuid.uuid4().hex}"
            fresh = fresh.withColumn("key_bucket", bucket).hint("rebalance", F.col("key_bucket"))
            fresh.sortWithinPartitions("key_bucket", *BRONZE_KEY).write.partitionBy("key_bucket").parquet(f"{path}/_data/{name}")
            if not _has_files(spark, f"{path}/_data/{name}"):
                delete(spark, f"{path}/_data/{name}")
                return _data(spark, path, names) if names else df.limit(0)
            if _commit(spark, path, version + 1, [*names, name]):
                return _data(spark, path, [*names, name])
            delete(spark, f"{path}/_data/{name}")
    finally:
        if staged:
            delete(spark, staged)
    raise RuntimeError(f"{path}: others committed first, {tries} times")


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """The table that append_bronze has made, as of its last commit."""
    return _data(spark, path, _latest(spark, path)[1])


def _folders(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/_data").parquet(*[f"{path}/_data/{n}" for n in names]).drop("_commit")


def _data(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return _folders(spark, path, names).drop("key_bucket")


def _fs(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _has_files(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return any(not x.getPath().getName().startswith(("_", ".")) and (x.isDirectory() or x.getLen()) for x in fs.listStatus(where))


def _latest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number of the last commit, data folders of the table); (0, []) for a new table."""
    fs, where = _fs(spark, f"{path}/_commits")
    if not fs.exists(where):
        return 0, []
    found = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().isdigit())
    if not found:
        return 0, []
    stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{found[-1]}"))
    try:
        return int(found[-1]), bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, version: int, names: Sequence[str]) -> bool:
    """Makes the file of the commit with its whole content, or finds that another writer has made it."""
    jvm = spark.sparkContext._jvm
    fs, to = _fs(spark, f"{path}/_commits/{version:020d}")
    fs.mkdirs(to.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write("\n".join(names).encode())
    out.close()
    try:
        if to.toUri().getScheme() in (None, "file"):  # a rename on a local disk would replace the other's file, a link doesn't
            try:
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (to, staged)]
                jvm.java.nio.file.Files.createLink(*local)
                return True
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                return False
        return not fs.exists(to) and bool(fs.rename(staged, to))
    finally:
        fs.delete(staged, False)


def retain(df: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Rows ingested within `days` days before as_of."""
    return df.filter(F.col("_ingested_at") >= as_of - F.expr(f"interval {int(days)} days"))


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("header", True).csv(path)


def write_windows(df: DataFrame, path: str, buckets: int = 16) -> None:
    """Window arrays with all their columns (session_id, user_id, window_no, y, x) as Parquet, files cut by size.

    Users, where known, are dealt to `buckets` folders (user_bucket, by hash), so that a reader of some users reads those
    only, and the number of files follows the bytes and not the users.
    """
    if "user_id" not in df.columns:
        df.hint("rebalance").write.mode("overwrite").parquet(path)
        return
    dealt = df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    dealt.hint("rebalance", F.col("user_bucket")).write.mode("overwrite").partitionBy("user_bucket").parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("session_id", "user_id", "window_no", "y", "x")


def write_event_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_gold(features: DataFrame, path: str, documents: Mapping[str, DataFrame]) -> None:
    """Features and splits as CSV by split_set, and each of `documents` (parameters, summary, names) as JSON."""
    features.write.mode("overwrite").option("header", True).partitionBy("split_set").csv(f"{path}/features")
    for name, df in documents.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_patients(spark: SparkSession, path: str) -> DataFrame:
    """Labelled windows for training: subject_id, window_id, features, label, time_to_loc."""
    return spark.read.parquet(path).select("subject_id", "window_id", "features", "label", "time_to_loc")
