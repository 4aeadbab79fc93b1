"""What changed between two crawls, as one table for each class of change.

Missing values count as zero values: a null title equals an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webloom.runtime import freed_shuffles, materialize

EDGE = ("src_url", "dst_url", "rel")
FINDING = ("kind", "value", "url")
# Names of the rules that can fail a run.
RULES = ("new-external-host", "new-secret", "new-finding", "appeared", "disappeared", "changed", "restructured", "any")


@dataclass(frozen=True)
class Crawl:
    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class DiffOptions:
    ignore_content: bool = False
    ignore_findings: bool = False


def tech_string(techs: Column, separator: str = ", ") -> Column:
    named = F.transform(techs, lambda t: F.concat(t["name"], F.when(F.coalesce(t["version"], F.lit("")) != "", F.concat(F.lit(" "), t["version"])).otherwise("")))
    return F.coalesce(F.array_join(F.array_sort(named), separator), F.lit(""))


def appeared_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("url"), "url", "left_anti")


def disappeared_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return appeared_nodes(new, old)


_STATE = ("status_code", "content_type", "title", "content_hash")


def _state(nodes: DataFrame, name: str) -> DataFrame:
    """url and what a diff looks at, named for a side."""
    return nodes.select("url", *[F.col(c).alias(f"{name}_{c}") for c in _STATE], tech_string(F.col("techs")).alias(f"{name}_techs"))


def _changes(options: DiffOptions) -> Column:
    """The array of changes between the sides o and n of _state()."""
    text = lambda side, c: F.coalesce(F.col(f"{side}_{c}"), F.lit(""))
    status = lambda side: F.when(F.coalesce(F.col(f"{side}_status_code"), F.lit(0)) == 0, "-").otherwise(F.col(f"{side}_status_code").cast("string"))
    one = lambda name, differ, a, b: F.when(differ, F.struct(F.lit(name).alias("field"), a.alias("old"), b.alias("new")))
    pair = lambda c: (text("o", c), text("n", c))
    fields = [
        one("status", F.coalesce("o_status_code", F.lit(0)) != F.coalesce("n_status_code", F.lit(0)), status("o"), status("n")),
        *[one(c, pair(c)[0] != pair(c)[1], *pair(c)) for c in ("content_type", "title")],
    ]
    if not options.ignore_content:
        a, b = pair("content_hash")
        fields.append(one("content", (a != "") & (b != "") & (a != b), a, b))
    fields.append(one("tech", F.col("o_techs") != F.col("n_techs"), F.col("o_techs"), F.col("n_techs")))
    return F.array_compact(F.array(*fields))


def changed_nodes(old: DataFrame, new: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(url, changes): for nodes in both, array of (field, old, new) in the order status, content_type, title, content, tech."""
    both = _state(old, "o").join(_state(new, "n"), "url")
    return both.select("url", _changes(options).alias("changes")).filter(F.size("changes") > 0)


def _one_side(old: DataFrame, new: DataFrame, keys: tuple[str, ...], parts: int = 0) -> DataFrame:
    """The distinct keys of one table only, with added (or removed), from one pass over both, in that many parts if it is said; nulls are equal."""
    both = old.select(*keys, F.lit(False).alias("now")).unionByName(new.select(*keys, F.lit(True).alias("now")))
    both = both.repartition(parts, *keys) if parts else both
    return both.groupBy(*keys).agg(F.min("now").alias("least"), F.max("now").alias("added")).filter("least = added").drop("least")


def appeared_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(*EDGE).distinct().join(old.select(*EDGE), list(EDGE), "left_anti")


def disappeared_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return appeared_edges(new, old)


def changed_edges(old: DataFrame, new: DataFrame, parts: int = 0) -> DataFrame:
    """(src_url, dst_url, rel, change): edges of one crawl only, `added` or `removed`, from one pass over both, in that many parts if it is said."""
    return _one_side(old, new, EDGE, parts).select(*EDGE, F.when(F.col("added"), F.lit("added")).otherwise(F.lit("removed")).alias("change"))


def restructured_edges(old: Crawl, new: Crawl) -> DataFrame:
    """(url, what, rel, other): a row for each edge change at a node in both crawls, added or removed, out or in."""
    end = lambda way, at, to: F.struct(F.col(at).alias("url"), F.concat("change", F.lit(f"_{way}")).alias("what"), "rel", F.col(to).alias("other"))
    each = changed_edges(old.edges, new.edges).select(F.explode(F.array(end("out", "src_url", "dst_url"), end("in", "dst_url", "src_url"))).alias("e")).select("e.*")
    both = old.nodes.select("url").join(new.nodes.select("url"), "url", "left_semi").withColumnRenamed("url", "_both")
    return each.join(both, F.col("url") == F.col("_both"), "left_semi")


def restructured(old: Crawl, new: Crawl) -> DataFrame:
    """(url, added_out, removed_out, added_in, removed_in): numbers of edge changes at nodes in both crawls."""
    counts = [F.count_if(F.col("what") == w).alias(w) for w in ("added_out", "removed_out", "added_in", "removed_in")]
    return restructured_edges(old, new).groupBy("url").agg(*counts)


def appeared_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select(*FINDING).distinct().join(old.select(*FINDING), list(FINDING), "left_anti")


def appeared_hosts(old: Crawl, new: Crawl) -> DataFrame:
    mine, theirs = (c.nodes.filter(F.col("external") & (F.col("host") != "")).select("host").distinct() for c in (new, old))
    return mine.join(theirs, "host", "left_anti")


def diff(old: Crawl, new: Crawl, options: DiffOptions = DiffOptions()) -> dict[str, DataFrame]:
    """All classes of change by name."""
    out = {
        "appeared": appeared_nodes(old.nodes, new.nodes),
        "disappeared": disappeared_nodes(old.nodes, new.nodes),
        "changed": changed_nodes(old.nodes, new.nodes, options),
        "appeared_edges": appeared_edges(old.edges, new.edges),
        "disappeared_edges": disappeared_edges(old.edges, new.edges),
        "restructured": restructured(old, new),
        "appeared_hosts": appeared_hosts(old, new),
        "disappeared_hosts": appeared_hosts(new, old),
    }
    if not options.ignore_findings:
        out |= {"appeared_findings": appeared_findings(old.findings, new.findings), "disappeared_findings": appeared_findings(new.findings, old.findings)}
    return out


def is_empty(changes: dict[str, DataFrame]) -> bool:
    """Whether no class of change has a row."""
    return not any(df.limit(1).count() for df in changes.values())


def rule_counts(changes: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): how often each rule is tripped. restructured counts changed outgoing edges only."""
    spark = changes["appeared"].sparkSession
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    none = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    findings = changes.get("appeared_findings")
    out = changes["restructured"].filter("added_out > 0 or removed_out > 0")
    counts = {
        "new-external-host": count(changes["appeared_hosts"]),
        "new-secret": none if findings is None else count(findings.filter(F.col("kind").contains("secret"))),
        "new-finding": none if findings is None else count(findings),
        "appeared": count(changes["appeared"]),
        "disappeared": count(changes["disappeared"]),
        "changed": count(changes["changed"]),
        "restructured": count(out),
    }
    # `any` is what makes a diff non-empty: nodes, edges and findings
    parts = [changes[c] for c in ("appeared", "disappeared", "changed", "appeared_edges", "disappeared_edges", "appeared_findings", "disappeared_findings") if c in changes]
    every = count(parts[0])
    for part in parts[1:]:
        every = every.unionByName(count(part))
    counts["any"] = every.agg(F.sum("n").alias("n"))
    rows = [df.select(F.lit(rule).alias("rule"), "n") for rule, df in counts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def count_rules(old: Crawl, new: Crawl, options: DiffOptions = DiffOptions(), parts: int = 0, waves: int = 2) -> DataFrame:
    """(rule, n): rule_counts() of the diff of two crawls, for when its rows are not wanted.

    A job for each table, in which a row of either crawl is moved once, instead of
    one job for all classes: its shuffles are gone when the next one begins. parts
    deals the edges to that many tasks. Edges, the most rows by far, are compared in
    waves by the hash of their keys, so that only a wave's lie in a shuffle at once.
    """
    spark = old.nodes.sparkSession
    row = lambda df, **counts: materialize(df.agg(*[c.alias(k) for k, c in counts.items()]), "counts").first().asDict()
    n = F.count(F.lit(1))
    with freed_shuffles(spark):
        links = None
        for wave in range(waves):
            own = [c.edges.filter(F.pmod(F.xxhash64(*EDGE), F.lit(waves)) == wave) for c in (old, new)]
            # a source's changed links; a hub's are counted in each part first
            changed = materialize(_one_side(*own, EDGE, parts).groupBy(F.col("src_url").alias("url")).agg(n.alias("n")), "links")
            links = changed if links is None else links.unionByName(changed)
        found = row(links, edges=F.coalesce(F.sum("n"), F.lit(0)))
        both = links.select("url").distinct().join(old.nodes.select("url"), "url", "left_semi").join(new.nodes.select("url"), "url", "left_semi")
        found |= row(both, restructured=n)
        sides = _state(old.nodes, "o").withColumn("o", F.lit(True)).join(_state(new.nodes, "n").withColumn("n", F.lit(True)), "url", "full_outer")
        found |= row(sides, appeared=F.count_if(F.isnull("o")), disappeared=F.count_if(F.isnull("n")), changed=F.count_if(F.col("o") & F.col("n") & (F.size(_changes(options)) > 0)))
        found |= row(appeared_hosts(old, new), hosts=n)
        found |= {"secret": 0, "found": 0, "gone": 0}
        if not options.ignore_findings:
            findings = _one_side(old.findings, new.findings, FINDING)
            found |= row(findings, secret=F.count_if(F.col("added") & F.col("kind").contains("secret")), found=F.count_if("added"), gone=F.count_if(~F.col("added")))
    changes = [found[k] for k in ("appeared", "disappeared", "changed")]
    counts = (found["hosts"], found["secret"], found["found"], *changes, found["restructured"], sum(changes) + found["edges"] + found["found"] + found["gone"])
    return spark.createDataFrame(list(zip(RULES, counts, strict=True)), "rule string, n long")


def write_diff(changes: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write each class of change as a table below path; the rule counts, taken while they are written.

    A class costs one job, whatever is counted of it; rule_counts() would compute
    each class once more for its counts. A class that has no rows makes a table
    without rows. An existing path is an error.
    """
    n = F.count(F.lit(1))
    more = {
        "restructured": {"out": F.count_if(F.expr("added_out > 0 or removed_out > 0"))},
        "appeared_findings": {"secret": F.count_if(F.coalesce(F.col("kind"), F.lit("")).contains("secret"))},
    }
    seen: dict[str, dict[str, int]] = {}
    for name, df in changes.items():
        counts = Observation()
        df.observe(counts, n.alias("n"), *[c.alias(k) for k, c in more.get(name, {}).items()]).write.parquet(f"{path.rstrip('/')}/{name}")
        seen[name] = counts.get
    of = lambda name, what="n": seen.get(name, {}).get(what, 0)
    return {
        "new-external-host": of("appeared_hosts"),
        "new-secret": of("appeared_findings", "secret"),
        "new-finding": of("appeared_findings"),
        "appeared": of("appeared"),
        "disappeared": of("disappeared"),
        "changed": of("changed"),
        "restructured": of("restructured", "out"),
        "any": sum(of(c) for c in ("appeared", "disappeared", "changed", "appeared_edges", "disappeared_edges", "appeared_findings", "disappeared_findings")),
    }


def parse_rules(text: str) -> tuple[str, ...]:
    """A comma list of rules, in any case; ValueError for an unknown one."""
    names = tuple(p.strip().lower() for p in text.split(",") if p.strip())
    for name in names:
        if name not in RULES:
            raise ValueError(f"unknown rule {name!r} (want one of: {', '.join(RULES)})")
    return names


def tripped(changes: dict[str, DataFrame], rules: str) -> list[str]:
    """Those of the named rules whose count is not 0."""
    wanted = parse_rules(rules)
    found = {r["rule"] for r in rule_counts(changes).filter("n > 0").collect()}
    return [r for r in wanted if r in found]
