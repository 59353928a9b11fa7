"""URL allow and block rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits a url when the url's host is the rule's host or below it and the url's path starts with the
rule's. With the host's labels reversed, a rule is a prefix of the keys it fits, hence an interval of the sorted
keys. Rule openings, rule closings and url keys are dealt out together by range of the key; inside each range one
sorted sweep keeps the stack of active rules as a running depth: the rule on top at a url is the last one opened at
the url's depth. Rules that are still open where a range begins are carried into it. Nothing is broadcast and no
range grows with a popular host or url, since ties are split by row number.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and gets the default verdict.
The longest fitting rule wins (by characters of host and path together, then of the host). Of equal rules, block wins.
Repeated rows and null ids are kept row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written
from .sweep import ranged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, CLOSE, URL = 0, -1, 1


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: see the module's defined cases."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("\0"), path), "utf-8")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (like `net/`, null if none fits) and verdict; rules has host, path, verdict.

    Columns of urls with these four names are replaced, all others kept. Work: a few keys for each url (one for each
    label of its host, up to as many as a rule has) are sorted once; then one shuffle by row number.
    """
    host, path = url_parts(F.col(url_col))
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    row, top = free_name(urls, "_row"), free_name(urls, "_top")
    rows = written(urls.select(*kept, host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias(row)))
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    # no rule looks further into a url than this
    deepest, longest = rules.agg(F.coalesce(F.max(F.size(labels)), F.lit(0)), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
    rules = rules.withColumn("key", _key(labels, F.col("path"))).withColumn(
        "rule", F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("nh"), F.concat("host", "path").alias("rule"), "verdict")
    )
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.slice(labels, 1, n))
    keys = (
        rows.filter(F.lit(deepest > 0) & (F.col("host") != ""))
        .select(F.col(row).alias("row"), F.substring("path", 1, longest).alias("path"), F.explode(suffixes).alias("labels"))
        .select(_key(F.col("labels"), F.col("path")).alias("key"), F.lit(URL).alias("kind"), "row", F.lit(None).cast(rules.schema["rule"].dataType).alias("rule"))
    )
    opens = rules.select("key", F.lit(OPEN).alias("kind"), F.lit(None).cast("long").alias("row"), "rule")
    closes = rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(CLOSE).alias("kind"), F.lit(None).cast("long").alias("row"), "rule")
    events = ranged(keys.unionByName(opens).unionByName(closes), ["key", "kind", "row"])
    ends = events.filter(F.col("kind") == CLOSE).select("rule", F.col("pid").alias("last"))
    carried = (
        events.filter(F.col("kind") == OPEN)
        .join(ends, "rule")
        .filter("last > pid")
        .withColumn("pid", F.explode(F.sequence(F.col("pid") + 1, F.col("last"))))
        .select("key", "kind", "row", "rule", "pid")
    )
    order = ("key", "kind", "row")
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    sweep = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("pid", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    best = (
        events.unionByName(carried)
        .withColumn("depth", F.sum(step).over(sweep))
        .withColumn("top", F.last(F.when(F.col("kind") == OPEN, F.col("rule")), ignorenulls=True).over(level))
        .filter((F.col("kind") == URL) & (F.col("depth") > 0))
        .groupBy(F.col("row").alias(row))
        .agg(F.max("top").alias(top))
    )
    out = rows.join(best, row, "left").withColumns({"rule": F.col(f"`{top}`.rule"), "verdict": F.coalesce(F.col(f"`{top}`.verdict"), F.lit(default))})
    return out.drop(row, top)
