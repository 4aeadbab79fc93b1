"""From stored responses to nodes, edges and findings, a set at a time.

responses(url, depth, kind, final_url, redirects, status_code, headers, body, error):
headers is a map of lower-case names to lists of values, body is text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fingerprint, html, js, passive
from webloom.functions.scope import CRAWL, RECORD, REJECT, ScopeRules
from webloom.functions.urls import canonical_url, is_js_path, resolve_url, url_host, url_path, url_scheme
from webloom.operators.frontier import kind_priority
from webloom.runtime import materialize

TECHS = "array<struct<name:string,version:string,categories:array<string>,confidence:int,evidence:array<string>>>"
#: Locations of a sitemap that count where a crawl has no limit of its own.
MAX_SITEMAP = 10_000
RESPONSES = "url string, depth int, kind string, final_url string, redirects array<string>, status_code int, headers map<string,array<string>>, body string, error string"


@dataclass(frozen=True)
class SiteGraph:
    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    candidates: DataFrame
    forms: DataFrame


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src_url, dst_url, rel), with the smallest context."""
    return edges.groupBy("src_url", "dst_url", "rel").agg(F.min("context").alias("context"))


def upsert_nodes(seen: DataFrame) -> DataFrame:
    """Sightings (url, kind, depth, external) to nodes: the least depth; of the kinds the first, `other` last; external as first seen."""
    first = F.struct("depth", kind_priority(F.col("kind")).alias("p"), "kind", "external")
    named = F.min(F.when(F.col("kind") != "other", first))
    out = seen.groupBy("url").agg(F.min("depth").alias("depth"), F.coalesce(named.getField("kind"), F.lit("other")).alias("kind"), F.min(first).getField("external").alias("external"))
    return out.select("url", "kind", url_scheme(F.col("url")).alias("scheme"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "depth", "external")


def header(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(F.element_at(headers, F.lit(name)), 0), F.lit(""))


def parse_responses(responses: DataFrame, signatures: tuple[fingerprint.Signature, ...] = fingerprint.SIGNATURES) -> DataFrame:
    """Responses with the class of their content, their parsed page, endpoints and matcher hits; written once."""
    ct = header(F.col("headers"), "content-type")
    path = url_path(F.col("url"))
    cls = (
        F.when(F.col("error").isNotNull() & (F.col("error") != ""), F.lit("none"))
        .when(html.is_html(ct), F.lit("html")).when(html.is_script(ct) | is_js_path(path), F.lit("script"))
        .when(html.is_xml(ct), F.lit("xml")).when(F.lower(ct).contains("css"), F.lit("css")).otherwise(F.lit("other"))
    )
    typed = responses.withColumns({"content_type": ct, "class": cls})
    paged = typed.withColumn("page", html.parse_html(F.when(F.col("class") == "html", F.col("body"))))
    scripts = F.when(F.col("class") == "script", F.array("body")).when(F.col("class") == "html", F.col("page.scripts"))
    out = paged.withColumns({"endpoints": js.script_endpoints(scripts), "script_text": js.script_literals(scripts)})
    body = F.when(F.col("class").isin("html", "script", "css"), F.col("body"))
    hits = fingerprint.match_pages(F.col("headers"), F.col("page.metas"), F.col("page.script_srcs"), F.col("page.classes"), body, url_path(F.col("url")), signatures)
    return materialize(out.withColumn("hits", hits), "parsed")


def references(parsed: DataFrame, max_sitemap: int = MAX_SITEMAP) -> DataFrame:
    """(src_url, depth, url, rel, kind, context): all references that resolve, from pages, scripts and sitemaps."""
    own = F.coalesce("final_url", "url")
    base = F.coalesce(F.when(F.coalesce("page.base", F.lit("")) != "", resolve_url(own, F.col("page.base"))), own)
    rows = parsed.select("url", "depth", base.alias("base"), "class", "page", "endpoints", "body")
    links = rows.select("url", "depth", "base", F.explode("page.refs").alias("r")).select(F.col("url").alias("src_url"), "depth", resolve_url(F.col("base"), F.col("r.ref")).alias("dst"), F.col("r.rel").alias("rel"), F.col("r.kind").alias("kind"), F.col("r.context").alias("context"))
    calls = rows.select("url", "depth", "base", F.explode(js.static_references(F.col("endpoints"))).alias("r")).select(F.col("url").alias("src_url"), "depth", resolve_url(F.col("base"), F.col("r")).alias("dst"), F.lit("js-endpoint").alias("rel"), F.lit("api").alias("kind"), F.lit("").alias("context"))
    found = html.sitemap_locations(F.when(F.col("class") == "xml", F.col("body")))
    listed = F.slice(F.concat(found["pages"], found["indexes"]), 1, max_sitemap)
    maps = rows.filter("class = 'xml'").select("url", "depth", F.explode(listed).alias("r")).select(F.col("url").alias("src_url"), "depth", canonical_url(F.col("r")).alias("dst"), F.lit("sitemap").alias("rel"), F.lit("page").alias("kind"), F.lit("").alias("context"))
    return links.unionByName(calls).unionByName(maps).filter("dst is not null").withColumnRenamed("dst", "url")


def response_findings(parsed: DataFrame) -> DataFrame:
    """(url, kind, value, evidence), distinct for each node, kind and value."""
    none = F.array().cast(passive.FINDING)
    apis = js.endpoint_findings(F.col("endpoints"))
    script = passive.findings(F.col("script_text"), apis)
    found = (
        F.when(F.col("class") == "html", F.concat(passive.findings(F.col("body")), passive.comment_findings(F.col("page.comments")), F.when(F.size("page.scripts") > 0, script).otherwise(none)))
        .when(F.col("class") == "script", script).when(F.col("class") == "css", passive.css_findings(F.col("body"))).otherwise(none)
    )
    rows = parsed.select("url", F.posexplode_outer(found).alias("at", "f")).filter("f is not null").select("url", "at", "f.*")
    return rows.groupBy("url", "kind", "value").agg(F.min_by("evidence", "at").alias("evidence"))


def redirect_edges(responses: DataFrame) -> DataFrame:
    """(src_url, dst_url, depth): each hop of the redirect chains, canonical, in order."""
    hops = F.filter(F.transform("redirects", lambda u: canonical_url(u)), lambda u: u.isNotNull())
    chain = responses.filter(F.size("redirects") > 0).select("url", "depth", F.concat(F.array("url"), hops).alias("c"))
    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.struct(a.alias("src_url"), b.alias("dst_url")))
    return chain.filter(F.size("c") > 1).select("depth", F.explode(pairs).alias("p")).select("p.*", "depth")


def build_graph(responses: DataFrame, rules: ScopeRules, signatures: tuple[fingerprint.Signature, ...] = fingerprint.SIGNATURES, max_sitemap: int = MAX_SITEMAP) -> SiteGraph:
    """Nodes, edges, findings, crawl candidates and forms of a set of responses, a row a URL.

    Of a sitemap's locations the first max_sitemap count.
    """
    parsed = parse_responses(responses, signatures)
    refs = references(parsed, max_sitemap)
    decision = rules.decide(F.col("url"), F.col("depth") + 1)
    refs = materialize(refs.withColumn("decision", decision).filter(F.col("decision") != REJECT).withColumn("external", (F.col("decision") == RECORD) & ~rules.in_scope_host(url_host(F.col("url")))), "refs")
    hops = redirect_edges(responses)
    outside = ~rules.in_scope_host(url_host(F.col("dst_url")))
    seen = parsed.select("url", "kind", "depth", F.lit(False).alias("external"))
    seen = seen.unionByName(refs.select("url", "kind", (F.col("depth") + 1).alias("depth"), "external"))
    seen = seen.unionByName(hops.select(F.col("dst_url").alias("url"), F.lit("page").alias("kind"), "depth", outside.alias("external")))
    failed = F.col("class") == "none"
    ok = ~failed
    body = F.coalesce("body", F.lit(""))
    results = parsed.select(
        F.col("url").alias("_url"),
        F.when(ok, html.kind_for_content_type(F.col("content_type"), F.col("kind"))).otherwise(F.col("kind")).alias("_kind"),
        (ok | ~F.coalesce("error", F.lit("")).contains("robots")).alias("fetched"),
        F.when(ok, F.coalesce("status_code", F.lit(0))).otherwise(0).alias("status_code"),
        F.when(ok, F.col("content_type")).otherwise("").alias("content_type"),
        F.when(ok, F.octet_length(body)).otherwise(0).cast("long").alias("content_length"),
        F.when(ok, html.content_hash(body)).otherwise("").alias("content_hash"),
        F.coalesce("page.title", F.lit("")).alias("title"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    techs = fingerprint.technologies(parsed.select("url", "hits"), signatures=signatures).withColumnRenamed("url", "_tech_url")
    nodes = upsert_nodes(seen).join(results, F.col("url") == F.col("_url"), "left").join(techs, F.col("url") == F.col("_tech_url"), "left")
    nodes = nodes.select(
        "url", F.coalesce("_kind", "kind").alias("kind"), "scheme", "host", "path", "depth", "external", F.coalesce("fetched", F.lit(False)).alias("fetched"),
        *[F.coalesce(c, F.lit(zero)).alias(c) for c, zero in (("status_code", 0), ("content_type", ""), ("content_length", 0), ("content_hash", ""), ("title", ""), ("error", ""))],
        F.coalesce("techs", F.array().cast(TECHS)).alias("techs"),
    )
    edges = refs.select("src_url", F.col("url").alias("dst_url"), "rel", "context").unionByName(hops.select("src_url", "dst_url", F.lit("redirect").alias("rel"), F.lit("").alias("context")))
    candidates = refs.filter(F.col("decision") == CRAWL).select("url", "kind", (F.col("depth") + 1).alias("depth"))
    forms = parsed.select("url", F.explode("page.forms").alias("f")).select("url", "f.*")
    return SiteGraph(nodes, dedup_edges(edges), response_findings(parsed), candidates, forms)
