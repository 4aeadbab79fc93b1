"""The crawl frontier as a table: order, de-duplication, budgets with counted drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.ordered import range_parts, running_totals


def kind_priority(kind: Column) -> Column:
    return F.when(kind == "page", 0).when(kind == "api", 1).when(kind == "script", 2).when(kind.isin("form", "document"), 3).otherwise(4)


def frontier_order(candidates: DataFrame) -> DataFrame:
    """Candidates (url, kind, depth) with seq, their place from 1 in the order of depth, kind and URL; a URL once."""
    best = candidates.groupBy("url").agg(F.min(F.struct("depth", kind_priority(F.col("kind")).alias("priority"), "kind")).alias("b"))
    rows = best.select("url", F.col("b.kind").alias("kind"), F.col("b.depth").alias("depth"), F.col("b.priority").alias("priority"))
    order = [F.col("depth"), F.col("priority"), F.col("url")]
    return running_totals(range_parts(rows, order, "frontier"), order, {"seq": F.lit(1).cast("long")})


def admit(candidates: DataFrame, visited: DataFrame, admitted: int, max_pages: int, max_queue: int = 100_000) -> DataFrame:
    """The frontier with an outcome for each new URL: admitted, budget-dropped or queue-dropped.

    visited (url) is left out. max_pages 0 is no limit. Only admitted URLs count
    as visited later; dropped ones may come again.
    """
    fresh = frontier_order(candidates.join(visited.select("url"), "url", "left_anti"))
    over = F.col("seq") > max(0, max_pages - admitted) if max_pages > 0 else F.lit(False)
    return fresh.withColumn("outcome", F.when(over, F.lit("budget-dropped")).when(F.col("seq") > max_queue, F.lit("queue-dropped")).otherwise(F.lit("admitted")))
