"""Many crawls of a target as one table of valid times, so that any two are compared by a filter on ranges.

Crawls are numbered in their order. Each state of a node (its URL with all that
a diff looks at), each edge and each finding has a row for every unbroken
stretch of crawls that hold it: from the first of them to the one after the
last. What is in crawl n has first <= n < until; nothing is joined to find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.diff import Crawl, changed_nodes

#: What of a node is told apart in time.
STATE = ("url", "kind", "host", "external", "fetched", "status_code", "content_type", "title", "content_hash", "techs")


def intervals(rows: DataFrame, crawl_col: str = "crawl", parts: int = 0) -> DataFrame:
    """rows in the columns other than crawl, with first and until for each stretch of consecutive crawl numbers.

    Repeats within a crawl count once; nulls are values like others. A window
    holds the crawls of one row only, so its size is the number of crawls. parts
    deals the rows to that many tasks by their keys, once for all steps; without it
    they are as many as the session's shuffles have.
    """
    keys = [c for c in rows.columns if c != crawl_col]
    rows = rows.repartition(parts, *keys) if parts else rows
    once = rows.select(*keys, F.col(crawl_col).cast("long").alias("_n")).distinct()
    # within a stretch the crawl's number and its place among the row's crawls grow alike
    placed = once.withColumn("_stretch", F.col("_n") - F.row_number().over(Window.partitionBy(*keys).orderBy("_n")))
    return placed.groupBy(*keys, "_stretch").agg(F.min("_n").alias("first"), (F.max("_n") + 1).alias("until")).drop("_stretch")


def extend(history: DataFrame, rows: DataFrame, crawl: int) -> DataFrame:
    """The history with one more crawl, numbered higher than those before: open stretches grow, others begin; closed rows pass through unread by the join."""
    keys = [c for c in history.columns if c not in ("first", "until")]
    now = rows.select(*keys).distinct().withColumns({"first": F.lit(crawl).cast("long"), "until": F.lit(crawl + 1).cast("long")})
    open_ = history.filter(F.col("until") == crawl).unionByName(now)
    grown = open_.groupBy(*keys).agg(F.min("first").alias("first"), F.max("until").alias("until"))
    return history.filter(F.col("until") != crawl).unionByName(grown)


def at(history: DataFrame, crawl: int | Column) -> DataFrame:
    """What crawl holds."""
    n = crawl if isinstance(crawl, Column) else F.lit(crawl)
    return history.filter((F.col("first") <= n) & (n < F.col("until"))).drop("first", "until")


def between(history: DataFrame, old: int, new: int) -> DataFrame:
    """The rows of one of two crawls only, with change `added` or `removed`: a filter, without a join."""
    held = lambda n: (F.col("first") <= n) & (F.lit(n) < F.col("until"))
    change = F.when(held(new), F.lit("added")).otherwise(F.lit("removed"))
    # a row that left and came back has a stretch for each of the two crawls
    one = history.filter(held(old) != held(new)).withColumn("change", change).drop("first", "until")
    keys = [c for c in one.columns if c != "change"]
    both = Window.partitionBy(*keys)
    return one.withColumn("_sides", F.count(F.lit(1)).over(both)).filter("_sides = 1").drop("_sides")


def node_history(crawls: list[Crawl], parts: int = 0) -> DataFrame:
    """States of nodes over crawls, numbered from 0."""
    return intervals(_stacked([c.nodes.select(*STATE) for c in crawls]), parts=parts)


def edge_history(crawls: list[Crawl], parts: int = 0) -> DataFrame:
    return intervals(_stacked([c.edges.select("src_url", "dst_url", "rel") for c in crawls]), parts=parts)


def finding_history(crawls: list[Crawl]) -> DataFrame:
    return intervals(_stacked([c.findings.select("kind", "value", "url") for c in crawls]))


def changed_between(nodes: DataFrame, old: int, new: int) -> DataFrame:
    """(url, changes) as diff.changed_nodes() has them, read from the states that are in one of the two crawls only."""
    moved = nodes.filter(((F.col("first") <= old) & (F.lit(old) < F.col("until"))) != ((F.col("first") <= new) & (F.lit(new) < F.col("until"))))
    return changed_nodes(at(moved, old), at(moved, new))


def lifetimes(history: DataFrame) -> DataFrame:
    """The rows of a history once each, with the crawls that first and last hold them, how many do, and how often they came back."""
    keys = [c for c in history.columns if c not in ("first", "until")]
    seen = F.sum(F.col("until") - F.col("first")).alias("crawls")
    return history.groupBy(*keys).agg(F.min("first").alias("first_seen"), (F.max("until") - 1).alias("last_seen"), seen, (F.count(F.lit(1)) - 1).alias("returns"))


def _stacked(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].withColumn("crawl", F.lit(0).cast("long"))
    for n, df in enumerate(tables[1:], 1):
        out = out.unionByName(df.withColumn("crawl", F.lit(n).cast("long")))
    return out
