"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

Every record is hashed where it lies. The leaves of a range of `range_bytes` offsets, each with its offset and length,
hash in offset order to one node; `fanout` neighbouring ranges, each with its number, hash to a node of the next level,
up to one root. So a record that moved changes its branch even if no byte of it did. Ranges are fixed by offset and not
by counting records, so a lost record changes its own branch only. Two replicas are compared at the root, and only
children of nodes that differ are read further down, until the damaged records stand alone.

Each level is one aggregation whose groups have a bounded size. Leaves and levels are written to the shared folder in
at most SHELVES folders by range; an audit names the folders of the differing nodes, so that the rest isn't read, and
joins the two trees level by level on node number.

Defined cases: a null url or html counts as empty in the record; records are ordered by id (null first), then url,
then hash, and repeated rows get their own offsets; an empty archive has the root hash of the empty string; equal
replicas give no rows; a moved record is missing at its old place and extra at its new one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .sweep import running_total

SHELVES = 256


def record_text(uri: Column, body: Column) -> Column:
    """A WARC response record as text: headers, empty line, body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def laid_out(pages: DataFrame, **held: tuple[Column, Column]) -> DataFrame:
    """(page_id, url, offset, length, sha256) of the archive that holds the pages in order of id. Written once.

    held: name=(url, html) adds a column `name`, the hash of what a replica holds at the record's place, null if its
    html is null because the record is lost there. Only hashes and lengths are sorted, not the bodies.
    """
    text = record_text(F.col("url"), F.col("html"))
    more = [F.when(body.isNotNull(), F.sha2(record_text(uri, body), 256)).alias(k) for k, (uri, body) in held.items()]
    rows = pages.select("page_id", "url", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"), *more)
    return running_total(rows, ["page_id", "url", "sha256"], "length", "_end", ["page_id", "url", (F.col("_end") - F.col("length")).alias("offset"), "length", "sha256", *held])


@dataclass
class Shelved:
    """A table in folders: rows whose `key` // width is the same lie in one of at most SHELVES folders."""

    df: DataFrame
    key: str
    width: int

    @staticmethod
    def of(df: DataFrame, key: str, least_width: int) -> Shelved:
        last = df.agg(F.max(key)).first()[0] or 0
        width = max(least_width, -(-(last + 1) // SHELVES))
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Shelved(written(df.withColumn("shelf", F.floor(F.col(key) / width).cast("int")).repartitionByRange(n, key), by="shelf"), key, width)

    def at(self, nodes: DataFrame) -> DataFrame:
        """The rows whose key is a node of nodes; reads only the folders these lie in."""
        shelves = [r[0] for r in nodes.select(F.floor(F.col("node") / self.width).cast("int")).distinct().collect()]  # SHELVES at most
        return self.df.filter(F.col("shelf").isin(shelves)).join(nodes, F.col(self.key) == nodes["node"], "left_semi").drop("shelf")


@dataclass
class Tree:
    """leaves: (offset, length, sha256, range, kept: a struct of kept columns); levels[k]: (node, parent, sha256), level 0 hashing
    ranges of leaves.
    """

    leaves: Shelved
    levels: list[Shelved]
    root: str

    def discard(self) -> None:
        discard(self.leaves.df, *[x.df for x in self.levels])


def _joined(*parts: str) -> Column:
    """Hash of the children in order, each as its parts; the first one orders them."""
    line = lambda x: F.concat_ws(" ", *[x[p].cast("string") for p in parts])
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*parts))), line), "\n"), 256)


def tree(records: DataFrame, range_bytes: int = 1 << 18, fanout: int = 64, keep: Sequence[str] = ()) -> Tree:
    """The Merkle tree of records (offset, length, sha256). keep: columns of records that an audit is to name."""
    # kept columns in a struct, where no name of ours can clash with theirs
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    leaves = records.select("offset", "length", "sha256", *kept).withColumn("range", F.floor(F.col("offset") / range_bytes).cast("long"))
    leaves = Shelved.of(leaves, "range", fanout)
    levels = []
    level = leaves.df.groupBy(F.col("range").alias("node")).agg(_joined("offset", "length", "sha256").alias("sha256"))
    while True:
        stored = Shelved.of(level.select("node", F.floor(F.col("node") / fanout).cast("long").alias("parent"), "sha256"), "parent", fanout)
        levels.append(stored)
        last = stored.df.agg(F.max("node")).first()[0]
        if not last:
            break
        level = stored.df.groupBy(F.col("parent").alias("node")).agg(_joined("node", "sha256").alias("sha256"))
    # the top level has node 0 alone
    row = levels[-1].df.first()
    return Tree(leaves, levels, row["sha256"] if row else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def _names(keep: Sequence[str]) -> dict[str, str]:
    """Names of the kept columns in an audit: their own, with underscores before those that the audit has itself."""
    names, taken = {}, {"offset", "length", "expected", "found", "state"}
    for c in keep:
        name = c
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names[c] = name
    return names


def audit(good: Tree, other: Tree, keep: Sequence[str] = ()) -> DataFrame:
    """(offset, length, expected, found, state, keep) of each record of `other` that is not as in `good`.

    state: altered, missing (found is null) or extra (expected is null). Equal roots end the audit at once. Both trees
    must have the same range_bytes and fanout and the kept columns; a tree may be higher than the other. length and the
    kept columns are those of the good record if there is one; a kept column with a name of the audit's own has an
    underscore before it.
    """
    none = good.levels[0].df.sparkSession.range(0).select(F.col("id").alias("node"))
    at, past = (None, None) if good.root != other.root else (none, None)
    for k in range(max(len(good.levels), len(other.levels)) - 1, -1, -1) if at is None else ():
        both = k < min(len(good.levels), len(other.levels))
        sides = []
        for t in (good, other):
            # where one tree has no such level, all nodes of the other are compared
            rows = t.levels[k] if k < len(t.levels) else None
            sides.append(none.withColumn("sha256", F.lit("")) if rows is None else (rows.at(at) if at is not None else rows.df).select("node", "sha256"))
        a, b = (x.withColumnRenamed("sha256", name) for x, name in zip(sides, ("expected", "found"), strict=True))
        now = written(a.join(b, "node", "full").filter(~F.col("expected").eqNullSafe(F.col("found"))).select("node"))
        discard(*[x for x in (past,) if x is not None])
        past, at = now, now if both else None
    sides = []
    for t, name in ((good, "expected"), (other, "found")):
        own = t.leaves.at(at)
        sides.append(own.select("offset", F.struct("length", F.col("sha256").alias("hash"), *(["kept"] if keep else [])).alias(name)))
    x = sides[0].join(sides[1], "offset", "full")
    same = F.col("expected.hash").eqNullSafe(F.col("found.hash")) & F.col("expected.length").eqNullSafe(F.col("found.length"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    one = F.coalesce("expected", "found")
    return x.filter(~same).select("offset", one["length"].alias("length"), F.col("expected.hash").alias("expected"), F.col("found.hash").alias("found"), state.alias("state"), *[one["kept"][c].alias(n) for c, n in _names(keep).items()])


def decayed() -> tuple[Column, Column]:
    """(url, html) of a damaged replica for drills: by the md5 of the url, a page in 256 is altered, another one lost."""
    mark = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 2)
    html = F.coalesce("html", F.lit(""))
    altered = F.concat(F.lit("~"), F.substring(html, F.lit(2), F.length(html)))
    return F.col("url"), F.when(mark == "00", altered).when(mark != "01", html)
