import pytest
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.robots import robots_allowed, robots_rules
from webloom.functions.scope import ScopeRules, path_has_prefix

CANON = [
    ("HTTP://shop.test/", "http://shop.test/"), ("https://SHOP.TEST/a", "https://shop.test/a"), ("https://shop.test./a", "https://shop.test/a"),
    ("https://shop.test:443/a", "https://shop.test/a"), ("http://shop.test:80/a", "http://shop.test/a"), ("https://shop.test:8443/a", "https://shop.test:8443/a"),
    ("https://shop.test", "https://shop.test/"), ("https://shop.test?x=1", "https://shop.test/?x=1"), ("https://shop.test/a/b/../c", "https://shop.test/a/c"),
    ("https://shop.test/../../a", "https://shop.test/a"), ("https://shop.test/a/", "https://shop.test/a/"), ("https://shop.test/a//b", "https://shop.test/a/b"),
    ("https://shop.test/A#part", "https://shop.test/A"), ("https://shop.test/a?b=2&a=1&&", "https://shop.test/a?a=1&b=2"),
    ("https://shop.test/a?utm_source=x&id=7", "https://shop.test/a?id=7"), ("https://shop.test/a?PHPSESSID=1&p", "https://shop.test/a?p"),
    ("https://u:p@shop.test/a", "https://shop.test/a"), ("  https://shop.test/a\n", "https://shop.test/a"), ("https://shop.test/für", "https://shop.test/f%C3%BCr"),
    ("https://shop.test/a%2fb,c;d", "https://shop.test/a%2fb,c;d"), ("https://shop.test/a b~*", "https://shop.test/a%20b~%2A"), ("https://shop.test/a+ü", "https://shop.test/a+%C3%BC"),
    ("https://[::1]:80/a", "https://[::1]:80/a"), ("mailto:a@b.test", None), ("ftp://shop.test/x", None), ("https:///path", None), ("", None), (None, None),
    ("https://shop.test/%zz", None), ("https://sh op.test/", None), ("https://shop.test:x/", None), ("/a", None),
]
RESOLVE = [
    ("x.html", "https://shop.test/d/x.html"), ("/r", "https://shop.test/r"), ("../u", "https://shop.test/u"), ("//cdn.test/x.js", "https://cdn.test/x.js"),
    ("http://o.test/x", "http://o.test/x"), ("?q=1", "https://shop.test/d/p.html?q=1"), ("#f", None), ("JavaScript:void(0)", None), ("mailto:a@b", None),
    ("  s.html ", "https://shop.test/d/s.html"), ("", None), (None, None), ("a:b", None), ("1a:b", None), ("a/b:c", "https://shop.test/d/a/b:c"),
]


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_canonical(spark):
    got = values(spark, [(a,) for a, _ in CANON], "u string", urls.canonical_url(F.col("u")))
    assert got == [b for _, b in CANON]
    again = [b for _, b in CANON if b]
    assert values(spark, [(a,) for a in again], "u string", urls.canonical_url(F.col("u"))) == again
    errors = values(spark, [(a,) for a, _ in CANON], "u string", urls.canon_error(F.col("u")))
    assert [e is None for e in errors] == [b is not None for _, b in CANON]


def test_resolve(spark):
    got = values(spark, [(a,) for a, _ in RESOLVE], "u string", urls.resolve_url(F.lit("https://shop.test/d/p.html?z=1#q"), F.col("u")))
    assert got == [b for _, b in RESOLVE]


@pytest.mark.parametrize("host,target,same", [("a.test", "a.test", True), ("w.a.test", "a.test", True), ("a.test:80", "a.test", True), ("a.test.evil.net", "a.test", False), ("nota.test", "a.test", False)])
def test_subdomain(spark, host, target, same):
    assert values(spark, [(host, target)], "h string, t string", urls.same_or_subdomain(F.col("h"), F.col("t"))) == [same]


def test_scope(spark):
    rules = ScopeRules(max_depth=2, exclude=("/private",), include=("/a", "/b"), path_prefix="/a").with_seed_host("Shop.test:443")
    rows = [("https://shop.test/a/x", 1), ("https://shop.test/a/private", 1), ("https://other.test/a", 1), ("https://shop.test/c", 1), ("https://shop.test/ab", 1), ("https://shop.test/a", 3), ("gopher://shop.test/a", 1), (None, 0), ("https://w.shop.test/a", 1)]
    got = values(spark, rows, "u string, d int", rules.decide(F.col("u"), F.col("d")))
    assert got == ["crawl", "reject", "record", "record", "record", "record", "reject", "reject", "record"]
    assert values(spark, [("/a/b",), ("/ab",), ("a",)], "p string", path_has_prefix(F.col("p"), "/a/")) == [True, False, True]
    with pytest.raises(ValueError, match="bad pattern"):
        ScopeRules(include=("(",))


def test_robots(spark):
    body = "User-agent: *\nDisallow: /x\n# c\nUser-agent: other\nUser-agent: loom\nDisallow: /p # why\nAllow: /p/open\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: https://a.test/s.xml\n"
    files = spark.createDataFrame([("a", body), ("b", "User-agent: *\nDisallow:\n"), ("c", None)], "origin string, body string")
    rules = robots_rules(files, "Loom/1.0").cache()
    assert sorted((r["kind"], r["value"]) for r in rules.filter("origin = 'a'").collect()) == [("allow", "/p/open"), ("crawl-delay", "2"), ("disallow", "/*.pdf$"), ("disallow", "/p"), ("sitemap", "https://a.test/s.xml")]
    paths = {("a", "/x"): True, ("a", "/p/1"): False, ("a", "/p/open/1"): True, ("a", "/d/f.pdf"): False, ("a", "/d/f.pdfx"): True, ("b", "/x"): True, ("c", "/"): True}
    got = robots_allowed(spark.createDataFrame(list(paths), "origin string, path string"), rules).collect()
    assert {(r["origin"], r["path"]): r["allowed"] for r in got} == paths
