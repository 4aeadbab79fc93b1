"""The questions one asks of a stored crawl, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import graph


def find_node(nodes: DataFrame, text: str) -> str | None:
    """The node that is text, or the smallest URL that ends with it."""
    exact = nodes.filter(F.col("url") == text).limit(1).count()
    return text if exact else nodes.filter(F.col("url").endswith(text)).agg(F.min("url").alias("u")).first()["u"]


def summary(nodes: DataFrame, edges: DataFrame, findings: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """(what, n): counts of a crawl, and its nodes by kind."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(~F.col("external")).alias("internal"), F.count_if("fetched").alias("fetched"))
    tall = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("what", "n"))
    for what, df in (("edges", edges), ("findings", findings), ("orphans", graph.orphans(nodes, edges, seeds)), ("third-party hosts", graph.external_hosts(nodes, edges))):
        tall = tall.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n"))
    return tall.unionByName(nodes.groupBy(F.concat(F.lit("kind "), F.col("kind")).alias("what")).agg(F.count(F.lit(1)).alias("n")))


def crawl_report(nodes: DataFrame, edges: DataFrame, findings: DataFrame, seeds: list[str] | None = None, dropped: dict[str, int] | None = None) -> DataFrame:
    """(what, n): the summary of a finished crawl, fetched nodes by status, technologies, and what limits cut off."""
    tall = summary(nodes, edges, findings, seeds)
    status = F.concat(F.lit("status "), F.col("status_code").cast("string"))
    tall = tall.unionByName(nodes.filter(F.col("fetched") & (F.col("status_code") > 0)).groupBy(status.alias("what")).agg(F.count(F.lit(1)).alias("n")))
    tall = tall.unionByName(graph.tech_summary(nodes).select(F.concat(F.lit("technology "), "tech").alias("what"), F.col("nodes").alias("n")))
    cut = nodes.sparkSession.createDataFrame([(f"cut off: {what}", n) for what, n in (dropped or {}).items() if n], "what string, n long")
    return tall.unionByName(cut)


def findings_by_kind(findings: DataFrame) -> DataFrame:
    """(kind, findings, nodes): how many of each kind, and on how many nodes."""
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("url").alias("nodes"))


def with_tech(nodes: DataFrame, text: str) -> DataFrame:
    """(url, name, version) of the first technology whose name holds the text, in any case."""
    hit = F.get(F.filter("techs", lambda t: F.lower(t["name"]).contains(text.lower())), 0)
    return nodes.select("url", hit.alias("t")).filter("t is not null").select("url", "t.name", "t.version")


def path_to(nodes: DataFrame, edges: DataFrame, text: str, seeds: list[str] | None = None) -> list[str]:
    """From the first seed, in the order of URLs, that reaches the node: the URLs on the way."""
    target = find_node(nodes, text)
    if target is None:
        return []
    return graph.path_from_first(edges, graph.seed_nodes(nodes, seeds).filter(~F.col("external")), target)


def links_to(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    target = find_node(nodes, text)
    return graph.in_edges(edges, target if target is not None else "").select("src_url", "rel").orderBy("src_url", "rel")


#: By name: of nodes, edges, findings, the question's value and the recorded seeds.
QUESTIONS: dict[str, Callable[..., DataFrame | list[str]]] = {
    "summary": lambda n, e, f, _, seeds=None: summary(n, e, f, seeds),
    "orphans": lambda n, e, f, _, seeds=None: graph.orphan_references(graph.orphans(n, e, seeds), e).orderBy("url"),
    "hubs": lambda n, e, f, x, seeds=None: graph.hubs(n, e, int(x or 20)),
    "external": lambda n, e, f, _, seeds=None: graph.external_hosts(n, e).orderBy(F.desc("references"), "host"),
    "tech": lambda n, e, f, x, seeds=None: with_tech(n, x).orderBy("url"),
    "status": lambda n, e, f, x, seeds=None: n.filter(F.col("status_code") == int(x)).select("url", "title").orderBy("url"),
    "findings": lambda n, e, f, x, seeds=None: f.filter(F.col("kind").contains(x or "")).select("kind", "value", "url").orderBy("kind", "value", "url"),
    "finding-kinds": lambda n, e, f, _, seeds=None: findings_by_kind(f).orderBy("kind"),
    "path-to": lambda n, e, f, x, seeds=None: path_to(n, e, x, seeds),
    "links-to": lambda n, e, f, x, seeds=None: links_to(n, e, x),
    "components": lambda n, e, f, _, seeds=None: graph.component_sizes(graph.components(n, e)).limit(10),
}
