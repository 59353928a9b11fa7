"""What both text classifiers need: the folds of documents and a bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by folds; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def sampled_labels(labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """At most most/2 training ids of each class (doc_id, y), lowest hash first, and the share of each class.

    Held-out rows, null ids and null labels are left out; a doc_id with several labels has the largest. Size: at
    most `most` rows, so the result may be broadcast.
    """
    one = labels.filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    one = one.filter(~held_out(F.col("doc_id")))
    n = dict(one.groupBy("y").count().collect())
    total = sum(n.values()) or 1
    by = [one.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    return by[0].unionByName(by[1]), {y: n.get(y, 0) / total for y in (0, 1)}
