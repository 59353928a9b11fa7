"""Sharding by global byte-size prefix sums: contiguous runs of documents of about equal size, DataFrame functions only.

Documents are in order of doc_id. They are dealt out by range without their texts; each partition's total, added up over
the partitions before it, turns prefix sums inside a partition into global ones. A document belongs to the shard in whose
share of all bytes its middle lies, so a shard misses its equal share by at most half a document at either end.

Only one row for each partition, and one for each shard, is ever in a single task. Equal keys are split by the text's
checksum and then by the row's place in the written table, so a doc_id (or null) that holds most rows is dealt out too.

Defined cases: a null text has no bytes and checksum 0; null doc_ids come first; rows with equal doc_id are in order of
checksum and size, so reruns agree up to rows that are alike; a document larger than a shard's share leaves other shards
without rows; an empty table gives no rows; other columns are ignored by `shards` and kept by `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, written
from .sweep import ranged

#: Bytes that a document takes besides its text.
OVERHEAD = 8


def _placed(docs: DataFrame, n: int, overhead: int, whole_rows: bool) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) and, for whole_rows, `row` with all of docs' columns."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    kept = ["row"] if whole_rows else []
    sized = written(docs.select("doc_id", (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *row))
    order = ["doc_id", "text_crc32", "size", "_at"]
    parts = ranged(sized.withColumn("_at", F.monotonically_increasing_id()), order)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("pid").agg(F.sum("size").alias("_n"), F.count("*").alias("_k"))
    past = totals.select("pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_rows"))
    whole = totals.agg(F.sum("_n").alias("_all"))
    within = Window.partitionBy("pid").orderBy(*order)
    here = parts.withColumns({"_upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(within)})
    both = here.join(F.broadcast(past), "pid").crossJoin(F.broadcast(whole))  # one row for each partition, and one row
    middle = 2 * (F.col("_bytes") + F.col("_upto")) - F.col("size")
    # integers all the way: 2 n times all bytes must stay below 2^63 (10^17 bytes in 46 shards)
    shard = F.least(F.expr(f"({n}L * _middle) div (2 * _all)"), F.lit(n - 1)).cast("int")
    placed = written(both.withColumn("_middle", middle).select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_nth") - 1).alias("_row"), *kept))
    discard(sized, parts)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), *kept)


def shards(docs: DataFrame, n: int = 24, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of docs (doc_id, text): shards 0 to n - 1, slot from 0 in each.

    size: the text's UTF-8 bytes and `overhead`. Slots follow the order of doc_id and have no gaps. Texts are read once
    and not shuffled.
    """
    return _placed(docs, n, overhead, False)


def write_shards(docs: DataFrame, path: str, n: int = 24, overhead: int = OVERHEAD) -> None:
    """docs with shard and slot as Parquet under path, a folder for each shard, its files in order of slot.

    Whole rows are dealt out, and then once more by range of (shard, slot), so that a file holds neighbours and no task a
    whole shard. Columns of docs called shard or slot stay; ours then have underscores before the name.
    """
    names = {c: free_name(docs, c) for c in ("shard", "slot")}
    placed = _placed(docs, n, overhead, True).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("row.*", *[F.col(c).alias(a) for c, a in names.items()]).write.partitionBy(names["shard"]).parquet(path)
