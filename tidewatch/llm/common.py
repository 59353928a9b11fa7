"""Helpers that the operators share: the cluster's shared folder, cut lineage, table reading, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local master may leave it unset (tests): it gets a new folder of this machine. On a cluster that is an error,
    since executors would write where nobody reads.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: survives lost executors, keeps only the columns later read.

    by: a column of few values that becomes folders, so that a filter on it reads those only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewatch_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


_made: ContextVar[list[DataFrame] | None] = ContextVar("_made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written inside, but for those given to the function that it yields."""
    made: list[DataFrame] = []
    before = _made.set(made)
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _made.reset(before)
        discard(*[t for t in made if not any(t is k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_tidewatch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def hot_keys(df: DataFrame, key: str, most: int = 500) -> tuple[DataFrame, int]:
    """(key, rows) of the keys that hold more than 1/most of df's rows, so fewer than `most` of them; and df's rows."""
    total = df.count()
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    return counts.filter(F.col("rows") > F.lit(max(64, total // most))), total


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined on key with small, which has one row for each key, without a hot key's rows meeting in one task.

    how: inner or left. Keys that hold more than 1/500 of big's rows are fewer than 500: their rows of small are
    broadcast, whatever the size of the tables; all other keys go through Spark's own join, and null keys through none.
    big should be a written table, as it is read more than once.
    """
    hot, _ = hot_keys(big.filter(F.col(key).isNotNull()), key)
    known = hot.select(key).collect()  # fewer than 500 rows, by the bound above
    rest = [c for c in small.columns if c != key]
    if known:
        keys = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in known], hot.select(key).schema))
        few = F.broadcast(small.join(keys, key, "left_semi"))
        others = big.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")
        out = others.join(small, key, how).unionByName(big.join(keys, key, "left_semi").join(few, key, how))
    else:
        out = big.filter(F.col(key).isNotNull()).join(small, key, how)
    if how == "left":
        types = dict(small.dtypes)
        out = out.unionByName(big.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in rest]))
    return out


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pieces(batch: pa.RecordBatch, col: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batch in slices whose strings in col come to about most_bytes, so that long texts don't add up."""
    sizes = pc.fill_null(pc.binary_length(batch[col]), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def summed(parts: DataFrame, fan: int = 32, levels: int = 3) -> dict[int, np.ndarray]:
    """Sums of arrays of doubles: parts (k int, x binary) has the bytes of one array for each partition and k.

    `fan` arrays of neighbouring partitions are added in a task, then `fan` of these sums, and so on; the driver adds
    what is left, one array for each fan^levels partitions (32,768).
    """

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), float) for x in t["x"])
        return pa.table({"k": t["k"].slice(0, 1), "at": t["to"].slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    now = parts.withColumn("at", F.spark_partition_id().cast("long"))
    for _ in range(levels):
        now = now.withColumn("to", F.floor(F.col("at") / fan).cast("long")).groupBy("k", "to").applyInArrow(added, "k int, at long, x binary")
    out: dict[int, np.ndarray] = {}
    for r in now.select("k", "x").toLocalIterator():
        x = np.frombuffer(bytes(r["x"]), float)
        out[r["k"]] = out[r["k"]] + x if r["k"] in out else x
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node of its class.

    Alternates large-star and small-star steps until all classes are stars. A step is a minimum per node, combined
    before the shuffle, and a join back, in which nodes with more than 1/500 of the edges (fewer than 1,000 of them) are
    joined by broadcast: the centre of a star that holds most of the edges is in no task whole. Nodes may be of any type
    with an order, structs too. Self-loops are ignored; no edges give no rows. Only the last step's table stays.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        # a star: each node points at one other, which points at none
        sides = now.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        state = sides.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).agg(F.sum("out"), F.count_if((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0))).first()
        if not state[1]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_with_minimum(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        small = _with_minimum(large, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).filter("u <> v").distinct())
        discard(now, large)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _with_minimum(edges: DataFrame, n: int) -> DataFrame:
    """n edges (u, v) with m, the smallest v of the edge's u."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    hot = [(r["u"], r["m"]) for r in low.filter(F.col("rows") > F.lit(max(256, n // 500))).select("u", "m").collect()]
    low = low.select("u", "m")
    if not hot:
        return edges.join(low, "u")
    few = F.broadcast(edges.sparkSession.createDataFrame(hot, low.schema))
    return edges.join(few, "u").unionByName(edges.join(few.select("u"), "u", "left_anti").join(low, "u"))
