"""Shortest paths by a search from both ends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.runtime import materialize

#: Steps of a path that one job walks.
STEPS_A_JOB = 16


@dataclass
class _Side:
    """A search from one end: edges from near to far, levels as they were written, what was visited, rows read."""

    edges: DataFrame
    levels: list[DataFrame]
    size: int = 1
    read: int = 0
    visited: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.visited = self.levels[0].select("url")

    def grow(self) -> None:
        step = self.edges.join(self.levels[-1].select(F.col("url").alias("near")), "near").groupBy(F.col("far").alias("url")).agg(F.min("near").alias("parent"), F.count(F.lit(1)).alias("ways"))
        fresh = materialize(step.join(self.visited, "url", "left_anti"), "level")
        row = fresh.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ways"), F.lit(0)).alias("ways")).first()
        self.size, self.read = row["n"], self.read + row["ways"]
        self.levels.append(fresh)
        self.visited = self.visited.unionByName(fresh.select("url"))

    def walk(self, url: str) -> list[str]:
        """From a node of the last level that was met to the end, both included; a job for every STEPS_A_JOB levels."""
        out, level = [url], next(k for k in range(len(self.levels) - 1, -1, -1) if self.levels[k].filter(F.col("url") == url).limit(1).count())
        while level > 0:
            at = self.edges.sparkSession.createDataFrame([(out[-1],)], "u0 string")
            low = max(0, level - STEPS_A_JOB)
            for k, n in enumerate(range(level, low, -1)):
                at = self.levels[n].select(F.col("url").alias(f"u{k}"), F.col("parent").alias(f"u{k + 1}")).join(F.broadcast(at), f"u{k}")
            row = at.first()
            out += [row[f"u{k}"] for k in range(1, level - low + 1)]
            level = low
        return out


def two_ended_path(edges: DataFrame, src: str, dst: str, rels: tuple[str, ...] = (), stats: dict[str, int] | None = None) -> list[str]:
    """URLs of a shortest way from src to dst, both included; empty if there is none.

    The side whose last level is smaller grows by a level, until its new level
    meets what the other has visited: then no shorter way exists, as a shorter
    one would have met a level before. Of several meeting nodes the smallest URL
    is taken, and of several parents the smallest. stats gets the numbers of
    levels and of edges that led to new nodes on each side. What is broadcast on
    the way back is one row. Nulls and self-loops in edges lead nowhere; a way
    from a node to itself is the node.
    """
    if src == dst:
        return [src]
    spark = edges.sparkSession
    used = edges.filter(F.col("rel").isin(*rels)) if rels else edges
    used = materialize(used.select("src_url", "dst_url").filter("src_url <> dst_url").distinct(), "used")
    start = lambda url: [materialize(spark.createDataFrame([(url, None, 0)], "url string, parent string, ways long"), "level")]
    sides = [_Side(used.toDF("near", "far"), start(src)), _Side(used.select(F.col("dst_url").alias("near"), F.col("src_url").alias("far")), start(dst))]
    while True:
        mine, other = sides if sides[0].size <= sides[1].size else sides[::-1]
        mine.grow()
        if stats is not None:
            stats |= {"forward_levels": len(sides[0].levels) - 1, "backward_levels": len(sides[1].levels) - 1, "forward_edges": sides[0].read, "backward_edges": sides[1].read}
        if not mine.size:
            return []
        # visited only one level deep can be met: nodes of earlier levels would have been met before
        met = mine.levels[-1].join(other.levels[-1].select("url"), "url", "left_semi").agg(F.min("url").alias("u")).first()["u"]
        if met is not None:
            return sides[0].walk(met)[::-1] + sides[1].walk(met)[1:]
