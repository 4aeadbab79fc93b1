"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.runtime import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    # REBALANCE keeps the join's own exchanges directly below it, so a hub's rows can be split
    joined = both.join(least.hint("rebalance"), F.col("u") == F.col("k"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = edges.join(least.hint("rebalance"), F.col("u") == F.col("k"))
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every id that has an edge to another id; component is the smallest id reachable.

    Edges are undirected; self-loops, nulls and repeats are ignored. Each round
    is written to the shared folder, so lineage stays short; the number of
    rounds grows with the logarithm of the longest chain.
    """
    current = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull().alias("a"), F.col(dst).isNotNull().alias("b"))
    current = materialize(current.filter("a and b and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        current = materialize(_small_star(_large_star(current)), "stars")
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
                current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = mark


def grow_components(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Components (id, component) after new edges, and the rows of it that are new or changed, from known (id, component).

    The ends of the new edges are replaced by their known labels, and components
    are found over these labels alone, in rounds over rows that are no more than
    the new edges. Known rows are read once for the labels and once to be
    relabelled; only those of components that were merged change. Self-loops and
    nulls are ignored; ids that only new edges have are added.
    """
    new = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct(), "grown")
    ends = new.select(F.col("u").alias("id")).union(new.select("v")).distinct()
    labels = materialize(ends.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("label"), F.col("component").isNull().alias("fresh")), "labels")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    merged = connected_components(new.join(of("u"), "u").join(of("v"), "v"), "u_label", "v_label")
    merged = materialize(merged.filter("id <> component").select(F.col("id").alias("_old"), F.col("component").alias("_new")), "merged")
    moved = known.join(merged, F.col("component") == F.col("_old")).select("id", F.col("_new").alias("component"))
    added = labels.filter("fresh").join(merged, F.col("label") == F.col("_old"), "left").select("id", F.coalesce("_new", "label").alias("component"))
    kept = known.join(merged, F.col("component") == F.col("_old"), "left_anti").select("id", "component")
    changed = materialize(moved.unionByName(added), "changed")
    return kept.unionByName(changed), changed
