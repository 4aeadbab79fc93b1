"""Site-graph analytics on node and edge tables keyed by URL.

nodes(url, kind, host, external, fetched, depth, ...), edges(src_url, dst_url,
rel). Edges are taken to be distinct, as build.dedup_edges() leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.components import connected_components
from webloom.operators.paths import two_ended_path
from webloom.runtime import materialize

# Kinds that a visitor can go to, and edges that make a node linked.
NAVIGABLE = ("page", "api", "form", "document")
ANCHORS = ("href", "link", "stylesheet", "script", "image", "media")
#: What reports say of an orphan that no edge leads to.
UNLINKED = "sitemap or seed list only"


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst_url").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src_url").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = nodes.join(in_degrees(edges), "url", "left").join(out_degrees(edges), "url", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("in_degree", "out_degree")})


def seed_nodes(nodes: DataFrame, seeds: list[str] | None) -> DataFrame:
    """Nodes of the seeds; those of depth 0 if no seeds are recorded."""
    return nodes.filter(F.col("url").isin(*seeds) if seeds else F.col("depth") == 0)


def orphans(nodes: DataFrame, edges: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """Own fetched navigable nodes, no seeds, that no link or load leads to."""
    seed = F.col("url").isin(*seeds) if seeds else F.col("depth") == 0
    own = nodes.filter(~F.col("external") & F.col("fetched") & F.col("kind").isin(*NAVIGABLE) & ~seed)
    anchors = edges.filter(F.col("rel").isin(*ANCHORS)).select("dst_url")
    return own.join(anchors, own["url"] == anchors["dst_url"], "left_anti")


def orphans_by_links(nodes: DataFrame, links: DataFrame, seeds: list[str] | None = None, unlinked: str | None = UNLINKED) -> DataFrame:
    """orphans() with their rels, from links counted by node (url, way, rel, n): both joins are on the node's URL."""
    anchors = links.filter((F.col("way") == "in") & F.col("rel").isin(*ANCHORS)).select(F.col("url").alias("dst_url"))
    found = orphans(nodes, anchors.withColumn("rel", F.lit(ANCHORS[0])), seeds)
    return orphan_references(found, links.filter("way = 'in'").select(F.col("url").alias("dst_url"), "rel"), unlinked)


def hubs_by_links(nodes: DataFrame, links: DataFrame, limit: int = 0) -> DataFrame:
    """hubs() from links counted by node."""
    own = nodes.filter(~F.col("external") & F.col("kind").isin(*NAVIGABLE)).select("url")
    n = links.filter("way = 'in'").groupBy("url").agg(F.sum("n").alias("in_degree"))
    ranked = own.join(n, "url", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))).orderBy(F.desc("in_degree"), "url")
    return ranked.limit(limit) if limit > 0 else ranked


def orphan_references(found: DataFrame, edges: DataFrame, unlinked: str | None = UNLINKED) -> DataFrame:
    """(url, rels): the kinds of edges that do lead to each orphan; unlinked where none does."""
    rels = edges.groupBy(F.col("dst_url").alias("url")).agg(F.array_join(F.array_sort(F.collect_set("rel")), ", ").alias("rels"))
    return found.select("url").join(rels, "url", "left").withColumn("rels", F.coalesce("rels", F.lit(unlinked).cast("string")))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """(url, in_degree) of own navigable nodes, most linked first; all of them for limit 0."""
    own = nodes.filter(~F.col("external") & F.col("kind").isin(*NAVIGABLE)).select("url")
    ranked = own.join(in_degrees(edges), "url", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))
    ranked = ranked.orderBy(F.desc("in_degree"), "url")
    return ranked.limit(limit) if limit > 0 else ranked


def external_hosts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, references) of third parties."""
    outside = nodes.filter(F.col("external") & (F.col("host") != "")).select("url", "host")
    counted = outside.join(in_degrees(edges), "url", "left")
    return counted.groupBy("host").agg(F.sum(F.coalesce("in_degree", F.lit(0))).alias("references"))


def tech_summary(nodes: DataFrame) -> DataFrame:
    """(tech, nodes): nodes by technology and version."""
    each = nodes.select(F.explode("techs").alias("t"))
    name = F.concat(F.col("t.name"), F.when(F.coalesce("t.version", F.lit("")) != "", F.concat(F.lit(" "), F.col("t.version"))).otherwise(""))
    return each.groupBy(name.alias("tech")).agg(F.count(F.lit(1)).alias("nodes"))


def bfs(edges: DataFrame, sources: DataFrame, target: str | None = None, max_levels: int = 0, rels: tuple[str, ...] = ()) -> DataFrame:
    """(url, level, parent) of all that can be reached from sources (url), or up to the target's level.

    One join per level: the frontier's edges, less what was visited. The parent
    is the smallest of the level before. Levels are written, so a lost executor
    costs no more than the current one.
    """
    used = edges.filter(F.col("rel").isin(*rels)) if rels else edges
    # written: each level joins it again; repeats of an edge make no difference to the parent, so they need no shuffle
    used = materialize(used.select("src_url", "dst_url"), "used")
    frontier = materialize(sources.select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")).dropDuplicates(["url"]), "level")
    visited, level = frontier, 0
    while True:
        if target is not None and frontier.filter(F.col("url") == target).limit(1).count():
            return visited
        if max_levels and level >= max_levels:
            return visited
        level += 1
        step = used.join(frontier.select(F.col("url").alias("src_url")), "src_url").groupBy(F.col("dst_url").alias("url")).agg(F.min("src_url").alias("parent"))
        step = step.join(visited.select("url"), "url", "left_anti").select("url", F.lit(level).alias("level"), "parent")
        frontier = materialize(step, "level")
        if not frontier.limit(1).count():
            return visited
        visited = visited.unionByName(frontier)


def shortest_path(edges: DataFrame, src: str, dst: str, rels: tuple[str, ...] = ()) -> list[str]:
    """URLs from src to dst, both included; empty if there is no way."""
    return two_ended_path(edges, src, dst, rels)


def path_from_first(edges: DataFrame, sources: DataFrame, dst: str) -> list[str]:
    """A shortest way to dst from the smallest of the sources (url) that reaches it; empty if none does.

    One search backwards from dst finds all that reach it, each with its next
    step, so the number of sources makes no difference.
    """
    back = edges.select(F.col("dst_url").alias("src_url"), F.col("src_url").alias("dst_url"))
    found = materialize(bfs(back, edges.sparkSession.createDataFrame([(dst,)], "url string")), "ways")
    at = found.join(sources.select("url").distinct(), "url", "left_semi").agg(F.min("url").alias("u")).first()["u"]
    path = []
    while at is not None:
        path.append(at)
        at = found.filter(F.col("url") == at).first()["parent"]
    return path


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, component): weakly connected components by their smallest URL; lone nodes are their own."""
    found = connected_components(edges, "src_url", "dst_url")
    return nodes.select("url").join(found, F.col("url") == F.col("id"), "left").select("url", F.coalesce("component", "url").alias("component"))


def component_sizes(found: DataFrame, samples: int = 5) -> DataFrame:
    """(component, size, sample), the largest first; the sample holds the smallest URLs."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    from pyspark.sql.window import Window

    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("component").orderBy("url"))).filter(F.col("_n") <= samples)
    listed = first.groupBy("component").agg(F.array_sort(F.collect_list("url")).alias("sample"))
    return sizes.join(listed, "component").orderBy(F.desc("size"), "component")


def out_edges(edges: DataFrame, url: str) -> DataFrame:
    return edges.filter(F.col("src_url") == url)


def in_edges(edges: DataFrame, url: str) -> DataFrame:
    return edges.filter(F.col("dst_url") == url)
