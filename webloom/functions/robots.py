"""robots.txt: rules as rows, and the verdict of the longest matching rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robots_rules(files: DataFrame, user_agent: str, origin_col: str = "origin", body_col: str = "body") -> DataFrame:
    """(origin, kind, value, seq) rows of kind allow, disallow, crawl-delay and sitemap that hold for an agent.

    Adjacent User-agent lines share a group. Of the groups whose token is part of
    the agent's name the last counts; if there is none, the first group of `*`.
    Sitemaps belong to no group. An empty Disallow allows `/`. The lines of one
    file are the bound of what one task orders.
    """
    agent = user_agent.lower()
    # of several files of one origin the first in the order of their texts counts
    files = files.groupBy(F.col(origin_col).alias("origin")).agg(F.min(body_col).alias("body"))
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("seq", "line"))
    line = F.trim(F.regexp_extract("line", r"^([^#]*)", 1), F.lit(" \t\r"))
    lines = lines.withColumn("line", line).filter(F.col("line").contains(":"))
    lines = lines.withColumns({"key": F.lower(F.trim(F.substring_index("line", ":", 1))), "value": F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), F.lit(" \t"))})
    by = Window.partitionBy("origin").orderBy("seq")
    is_agent = F.col("key") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag("key").over(by) == "user-agent", F.lit(False))
    lines = lines.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(by))
    token = F.lower("value")
    ours = is_agent & (token != "*") & F.lit(agent).contains(token)
    whole = Window.partitionBy("origin")
    lines = lines.withColumns({"own": F.max(F.when(ours, F.col("group"))).over(whole), "star": F.min(F.when(is_agent & (token == "*"), F.col("group"))).over(whole)})
    chosen = F.col("group") == F.coalesce("own", "star")
    kind = (
        F.when(F.col("key") == "sitemap", F.lit("sitemap"))
        .when(chosen & (F.col("key") == "disallow"), F.when(F.col("value") == "", F.lit("allow")).otherwise(F.lit("disallow")))
        .when(chosen & (F.col("key") == "allow") & (F.col("value") != ""), F.lit("allow"))
        .when(chosen & (F.col("key") == "crawl-delay") & (F.expr("try_cast(value AS double)") > 0), F.lit("crawl-delay"))
    )
    value = F.when((F.col("key") == "disallow") & (F.col("value") == ""), F.lit("/")).otherwise(F.col("value"))
    return lines.select("origin", kind.alias("kind"), value.alias("value"), "seq").filter("kind is not null")


def rule_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: `*` is any text, a final `$` the end."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def literal_prefix(pattern: Column) -> Column:
    """What every matching path begins with: the pattern up to its first `*` or its final `$`."""
    return F.regexp_extract(pattern, r"^([^*]*?)(?:\*.*|\$)?$", 1)


def rule_candidates(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(_ro_origin, _ro_path, n, ok, regex): the rules that a path may match, by their literal prefixes.

    Rules without `*` and `$` are one row for each prefix of an origin (allow wins)
    and have no regex: their prefix decides. A path looks up its own beginnings,
    of the lengths that its origin's rules have, by equality; so it meets a row
    for each length at most, and rules with `*` or `$` only where their prefix fits.
    """
    r = rules.filter(F.col("kind").isin("allow", "disallow")).select(
        F.col("origin").alias("_ru_origin"), literal_prefix(F.col("value")).alias("_ru_prefix"), F.length("value").alias("n"), (F.col("kind") == "allow").alias("ok"), "value"
    )
    regex = F.when(F.col("value") != F.col("_ru_prefix"), rule_regex(F.col("value"))).alias("regex")
    r = r.groupBy("_ru_origin", "_ru_prefix", "n", regex).agg(F.max("ok").alias("ok"))
    # an origin has as many lengths as its longest rule has characters, at most
    lengths = r.groupBy(F.col("_ru_origin").alias("_le_origin")).agg(F.collect_set(F.length("_ru_prefix")).alias("_lengths"))
    begun = pairs.join(lengths, F.col("_ro_origin") == F.col("_le_origin"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("_ro_path"))
    begun = begun.withColumn("_length", F.explode(fitting)).withColumn("_prefix", F.expr("substring(_ro_path, 1, _length)"))
    found = begun.join(r, (F.col("_ro_origin") == F.col("_ru_origin")) & (F.col("_prefix") == F.col("_ru_prefix")))
    return found.select("_ro_origin", "_ro_path", "n", "ok", "regex")


def robots_allowed(urls: DataFrame, rules: DataFrame, origin_col: str = "origin", path_col: str = "path") -> DataFrame:
    """urls with a column allowed: by the longest matching rule, allow at equal length; true where none matches."""
    pairs = urls.select(F.col(origin_col).alias("_ro_origin"), F.col(path_col).alias("_ro_path")).distinct()
    hit = F.col("regex").isNull() | F.call_function("rlike", F.col("_ro_path"), F.col("regex"))
    best = F.max(F.when(hit, F.struct("n", "ok")))
    verdict = rule_candidates(pairs, rules).groupBy("_ro_origin", "_ro_path").agg(best.alias("_ro_best"))
    joined = urls.join(verdict, (urls[origin_col] == verdict["_ro_origin"]) & (urls[path_col] == verdict["_ro_path"]), "left")
    return joined.select(*[urls[c] for c in urls.columns], F.coalesce("_ro_best.ok", F.lit(True)).alias("allowed"))
