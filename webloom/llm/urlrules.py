"""URL filter: pattern rules indexed by their rarest literal token. DataFrame operations only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast; more are joined by a shuffle on the token.
BROADCAST_RULES = 50_000
#: The token of rules that have no literal one: such rules are candidates for every URL.
ANY = "*"


@dataclass(frozen=True)
class Rule:
    """A regular expression on `host + path` (kind host) or on the lower-cased URL (kind url).

    tokens are literals that every match holds as whole runs of [a-z0-9].
    Rules of kind host win over those of kind url, then the longest name wins.
    """

    name: str
    verdict: str
    kind: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule such as `example.com/en/`: this host and its subdomains, paths that start with `/en/`."""
    host, slash, path = rule.partition("/")
    key = host + slash + path
    # a run that touches the open end of the path may go on in the URL, so it is no whole token
    tokens = re.findall(r"[a-z0-9]+(?![a-z0-9]|\Z)", key) if re.search(r"[a-z0-9]\Z", key) else re.findall(r"[a-z0-9]+", key)
    if re.search(r"[A-Z]", path):
        tokens = re.findall(r"[a-z0-9]+", host)
    return Rule(rule, verdict, "host", rf"\A(?:[^/]*\.)?{_quoted(key)}", tuple(tokens))


def token_rule(name: str, verdict: str, before: str, token: str, after: str) -> Rule:
    """A rule for a literal token between two regular expressions that keep it a whole run."""
    return Rule(name, verdict, "url", f"{before}{_quoted(token)}{after}", tuple(re.findall(r"[a-z0-9]+", token)))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The verdict for URLs that no host rule fits: blocked if one of these patterns is found in them.
DEFAULT_PATTERNS = tuple(
    [token_rule(f"part:{w}", "block", r"[/.]", w, r"(?:[/.?#]|$)") for w in ("ads", "adserver", "banner", "doubleclick", "tracker", "casino", "porn", "login", "signup", "cart")]
    + [token_rule(f"query:{w}", "block", r"[?&]", w, r"=") for w in ("sessionid", "sid", "token", "redirect", "replytocom")]
    + [token_rule(f"file:{w}", "block", r"\.", w, r"(?:[?#]|$)") for w in ("exe", "zip", "iso", "apk")]
)


def url_host(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as rows (read from one literal, so that no Python runs on executors and the plan stays small)."""
    place = {name: -k for k, name in enumerate(sorted({r.name for r in rules}))}
    rows = [{"rule": r.name, "place": place[r.name], "rule_verdict": r.verdict, "kind": r.kind, "pattern": r.pattern, "tokens": r.tokens, "rule_id": k} for k, r in enumerate(rules)]
    schema = "array<struct<rule_id int, rule string, place int, rule_verdict string, kind string, pattern string, tokens array<string>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("r")).select("r.*")


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every URL: (page_id, url, host, path, rule, rule_kind, verdict), a row per input row.

    Each rule stands in the index under that of its literal tokens which fewest
    URLs hold. The distinct tokens of a URL (runs of [a-z0-9] of the lower-cased
    text) fetch candidate rules, and only those run their regular expressions.
    Rules of kind host come before those of kind url; among them the longest
    name wins, then the smaller name (of equal names, block). rule is null and the verdict the default
    where none matches.

    A null URL, and one without `://`, has empty host and path, so no host rule
    fits it; patterns are still tried on its text. Repeated rows are judged each
    on their own; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    lowered = F.translate(F.coalesce(F.col(url_col), F.lit("")), UPPER, LOWER)
    tokens = F.concat(F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9]+"), lambda t: t != "")), F.array(F.lit(ANY)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    table = _rule_table(spark, rules)
    small = len(rules) <= BROADCAST_RULES
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    used = table.select(F.explode("tokens").alias("token")).distinct()
    seen = pages.select(F.explode(tokens).alias("token")).join(hint(used), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    choice = table.select("rule_id", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    rarest = choice.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit(ANY)))).getField("col2").alias("token"))
    index = materialize(table.join(rarest, "rule_id").select("token", "rule", "place", "rule_verdict", "kind", "pattern"), "rules")

    lowered = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    tokens = F.concat(F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9]+"), lambda t: t != "")), F.array(F.lit(ANY)))
    fetched = rows.withColumn("token", F.explode(tokens)).join(hint(index), "token", "left")
    key = F.when(F.col("kind") == "host", F.concat("host", "path")).otherwise(lowered)
    hit = F.col("pattern").isNotNull() & F.call_function("rlike", key, F.col("pattern"))
    # the best rule is the largest: host rules first, then the longest; places fall as names rise, so the smaller name breaks ties
    rank = F.struct((F.col("kind") == "host").alias("h"), F.length("rule").alias("n"), F.col("place"), F.col("rule_verdict"), F.col("rule"), F.col("kind"))
    best = fetched.groupBy("_row", "page_id", "url", "host", "path").agg(F.max(F.when(hit, rank)).alias("best"))
    return best.select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.kind").alias("rule_kind"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
