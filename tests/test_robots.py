"""robots.txt verdicts by prefix look-up against trying every rule."""

import random
import re

from pyspark.sql import functions as F

from webloom.functions.robots import literal_prefix, robots_allowed, rule_candidates


def matches(pattern, path):
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
    return re.match(body + ("$" if end else ""), path) is not None


def allowed(path, rules):
    hits = [(len(value), kind == "allow") for kind, value in rules if matches(value, path)]
    return max(hits)[1] if hits else True


def test_verdicts_are_those_of_all_rules(spark):
    rng = random.Random(1)
    part = lambda: rng.choice(["a", "b", "ab", "é", ".", "+", "(", "$x"])
    rules, urls = [], []
    for o in range(6):
        for k in range(40):
            value = "/" + "".join(rng.choice([part(), "/", "*"]) for _ in range(rng.randint(0, 5))) + rng.choice(["", "", "", "$", "*"])
            rules.append((f"o{o}", rng.choice(["allow", "disallow", "disallow"]), value, k))
        rules.append((f"o{o}", "crawl-delay", "2", 99))
        urls += [(f"o{o}", "/" + "".join(rng.choice([part(), "/"]) for _ in range(rng.randint(0, 6))), i) for i in range(60)]
    urls += [("none", "/a", 1), ("o1", "", 1), ("o1", None, 1), (None, "/a", 1)]
    frame = spark.createDataFrame(urls, "origin string, path string, n int")
    got = {(r["origin"], r["path"]): r["allowed"] for r in robots_allowed(frame, spark.createDataFrame(rules, "origin string, kind string, value string, seq int")).collect()}
    want = {(o, p): allowed(p, [(k, v) for ro, k, v, _ in rules if ro == o and k != "crawl-delay"]) if p is not None else True for o, p, _ in urls}
    assert got == want and {True, False} == set(want.values())


def test_literal_prefixes(spark):
    patterns = ["/", "/a", "/a$", "/a*", "/a*b$", "*x", "", "$", "/a$b", "/$*"]
    rows = spark.createDataFrame([(p,) for p in patterns], "p string").coalesce(1)
    assert [r[0] for r in rows.select(literal_prefix(F.col("p"))).collect()] == ["/", "/a", "/a", "/a", "/a", "", "", "", "/a$b", "/$"]


def test_a_host_of_many_rules_and_paths(spark):
    rules = spark.range(10_000).select(F.lit("hot").alias("origin"), F.when(F.col("id") % 3 == 0, "allow").otherwise("disallow").alias("kind"), F.concat(F.lit("/d"), F.col("id") % 5000, F.when(F.col("id") >= 5000, F.lit("/")).otherwise(F.lit(""))).alias("value"))
    rules = rules.unionByName(spark.createDataFrame([("hot", "disallow", "/*.pdf$")], "origin string, kind string, value string"))
    urls = spark.range(100_000).select(F.lit("hot").alias("origin"), F.concat(F.lit("/d"), F.col("id") % 20_000, F.lit("/p"), "id", F.when(F.col("id") % 1000 == 0, F.lit(".pdf")).otherwise(F.lit(""))).alias("path"))
    candidates = rule_candidates(urls.select(F.col("origin").alias("_ro_origin"), F.col("path").alias("_ro_path")), rules).count()
    # prefixes are of 7 lengths; all pairs would be 1,000,100,000
    assert 100_000 <= candidates <= 700_000
    got = {r["path"]: r["allowed"] for r in robots_allowed(urls, rules).filter("path like '/d12/%' or path like '%.pdf'").collect()}
    assert len(got) == 105
    listed = [(r["kind"], r["value"]) for r in rules.filter("value in ('/d1', '/d12', '/d1/', '/d12/', '/*.pdf$', '/d0', '/d0/')").collect()]
    for path, verdict in got.items():
        if path.startswith("/d12/"):
            assert verdict == allowed(path, listed), path
