"""Crawl a stored corpus of responses level by level, as a crawler would walk the live site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.robots import robots_allowed, robots_rules
from webloom.functions.scope import CRAWL, ScopeRules
from webloom.functions.urls import canonical_url, url_host, url_path, url_scheme
from webloom.operators.build import MAX_SITEMAP, SiteGraph, build_graph, parse_responses, references
from webloom.operators.frontier import admit
from webloom.runtime import materialize

USER_AGENT = "webloom/0.1"


@dataclass(frozen=True)
class CrawlOptions:
    """Limits of 0 mean none. max_pages counts admitted URLs."""

    rules: ScopeRules
    max_pages: int = 2000
    max_queue: int = 100_000
    respect_robots: bool = True

    def sitemap_limit(self) -> int:
        """How many locations of one sitemap count."""
        return self.max_pages or MAX_SITEMAP


@dataclass(frozen=True)
class CrawlResult:
    graph: SiteGraph
    status: str
    admitted: int
    budget_dropped: int
    queue_dropped: int


def sitemap_seeds(responses: DataFrame, robots: DataFrame | None, options: CrawlOptions, seeds: DataFrame) -> DataFrame:
    """(url, kind, depth): pages that the hosts' sitemaps list, at depth 1, half of max_pages at most."""
    origins = seeds.select(F.concat(url_scheme(F.col("url")), F.lit("://"), url_host(F.col("url"))).alias("origin")).distinct()
    files = origins.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"))
    if robots is not None:
        listed = robots.filter("kind = 'sitemap'").join(origins, "origin", "left_semi")
        files = files.unionByName(listed.select(canonical_url(F.col("value")).alias("url")))
    found = responses.join(files.distinct(), "url", "left_semi")
    refs = references(parse_responses(found.withColumns({"depth": F.lit(0), "kind": F.lit("document")})), options.sitemap_limit()).filter("rel = 'sitemap'")
    pages = refs.select("url").distinct().filter(options.rules.decide(F.col("url"), F.lit(1)) == CRAWL)
    limit = max(1, options.max_pages // 2) if options.max_pages else 1000
    return pages.orderBy("url").limit(limit).select("url", F.lit("page").alias("kind"), F.lit(1).alias("depth"))


def crawl_corpus(responses: DataFrame, seeds: list[str], options: CrawlOptions) -> CrawlResult:
    """Walk responses from the seeds; URLs without a stored response become unfetched nodes.

    Levels are synchronous, so a node's depth is its distance from the seeds.
    Within a level the order is kind and then URL. The status is
    budget-exceeded if any candidate was dropped, else complete.
    """
    spark = responses.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "raw string").select(canonical_url(F.col("raw")).alias("url")).filter("url is not null").distinct()
    rules = options.rules
    for row in start.select(url_host(F.col("url")).alias("h")).distinct().collect():
        rules = rules.with_seed_host(row["h"])
    options = CrawlOptions(rules, options.max_pages, options.max_queue, options.respect_robots)
    origin = F.concat(url_scheme(F.col("url")), F.lit("://"), url_host(F.col("url")))
    robots = materialize(robots_rules(responses.filter(url_path(F.col("url")) == "/robots.txt").filter("status_code = 200").select(origin.alias("origin"), "body"), USER_AGENT), "robots")
    candidates = start.select("url", F.lit("page").alias("kind"), F.lit(0).alias("depth")).unionByName(sitemap_seeds(responses, robots, options, start))
    visited = materialize(start.select("url").limit(0), "visited")
    done, admitted, dropped, queued, level = None, 0, 0, 0, 0
    waiting = candidates
    while True:
        judged = materialize(admit(waiting.filter(F.col("depth") <= level), visited, admitted, options.max_pages, options.max_queue), "judged")
        counts = {r["outcome"]: r["n"] for r in judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        later = waiting.filter(F.col("depth") > level)
        dropped, queued = dropped + counts.get("budget-dropped", 0), queued + counts.get("queue-dropped", 0)
        if counts.get("admitted"):
            admitted += counts["admitted"]
            frontier = judged.filter("outcome = 'admitted'").select("url", "kind", "depth")
            visited = visited.unionByName(frontier.select("url"))
            fetched = frontier.join(responses.drop("kind", "depth"), "url")
            if options.respect_robots:
                tested = robots_allowed(fetched.withColumns({"_origin": origin, "_path": url_path(F.col("url"))}), robots, "_origin", "_path")
                refused = ~F.col("allowed")
                fetched = tested.withColumns({"error": F.when(refused, F.lit("disallowed by robots.txt")).otherwise(F.col("error")), "body": F.when(~refused, F.col("body"))}).drop("allowed", "_origin", "_path")
            got = materialize(fetched, "fetched")
            done = got if done is None else done.unionByName(got)
            found = references(parse_responses(got), options.sitemap_limit())
            found = found.filter(rules.decide(F.col("url"), F.col("depth") + 1) == CRAWL).select("url", "kind", (F.col("depth") + 1).alias("depth"))
            later = later.unionByName(found)
        waiting = materialize(later, "waiting")
        if not waiting.limit(1).count():
            break
        level += 1
    if done is None:
        done = responses.limit(0)
    status = "budget-exceeded" if dropped or queued else "complete"
    return CrawlResult(build_graph(done, rules, max_sitemap=options.sitemap_limit()), status, admitted, dropped, queued)
