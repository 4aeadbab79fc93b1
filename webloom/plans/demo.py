"""Site graphs made of the driver's tables, as DataFrames and as DuckDB SQL.

G_fk turns foreign keys into URLs: orders link to customers, customers to
nations, nations to regions; orders call parts and load scripts of suppliers.
Two crawls of it differ by the order dates they cover and by changes that key
arithmetic makes. G_pages is the pages table with its links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url, url_host
from webloom.operators.diff import Crawl
from webloom.runtime import shuffle_partitions

SITE = "https://shop.example.com"
BODY = "array<struct<name:string,version:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a crawl, and so about twice as many edges, that one task or bucket takes.
PART_LINES = 250_000


def row_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts or buckets for tables of a crawl: eight at least, and as many more as keep each of bounded size."""
    return max(8, -(-table(spark, sf_dir, "lineitem").count() // PART_LINES))


def _url(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{SITE}/{kind}/"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def _supplier(key: Column) -> Column:
    return F.concat(F.lit("https://s"), key.cast("string"), F.lit(".example.net/w.js"))


def crawl(spark: SparkSession, sf_dir: str, side: str = "all") -> Crawl:
    """The crawl of all orders, or the old or new one of a pair."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    new = side == "new"
    if side == "old":
        orders = orders.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp"))
    if new:
        orders = orders.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
    kept = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    # dealt by number, as keys are so small in a shuffle that merged parts would be large in memory
    n = row_parts(spark, sf_dir)
    of = kept.select(F.col("o_orderkey").alias("l_orderkey")).repartition(n, "l_orderkey")
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey").repartition(n, "l_orderkey").join(of, "l_orderkey", "left_semi")
    parts = lines.filter(F.col("l_partkey") % 13 != 0) if new else lines
    supplier = F.col("l_suppkey") + (1 if new else 0)
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edge = lambda df, a, b, rel: df.select(a.alias("src_url"), b.alias("dst_url"), F.lit(rel).alias("rel"))
    edges = edge(kept, _url("order", "o_orderkey"), _url("customer", "o_custkey"), "href")
    edges = edges.unionByName(edge(customers, _url("customer", "c_custkey"), _url("nation", "c_nationkey"), "href"))
    edges = edges.unionByName(edge(nations, _url("nation", "n_nationkey"), _url("region", "n_regionkey"), "href"))
    # keys are made distinct before they become URLs: they lie by order already, so no URL is shuffled
    called = parts.select("l_orderkey", "l_partkey").distinct()
    loaded = lines.select("l_orderkey", supplier.alias("s")).distinct()
    edges = edges.unionByName(edge(called, _url("order", "l_orderkey"), _url("part", "l_partkey"), "js-endpoint"))
    edges = edges.unionByName(edge(loaded, _url("order", "l_orderkey"), _supplier(F.col("s")), "script"))
    k = F.col("o_orderkey")
    no_techs = F.array().cast(BODY)

    def node(df: DataFrame, url: Column, kind: str, depth: int, external: bool = False, status: Column | None = None, title: Column | None = None, body: Column | None = None, techs: Column | None = None) -> DataFrame:
        zero = F.lit(0) if external else F.lit(200)
        return df.select(
            url.alias("url"), F.lit(kind).alias("kind"), url_host(url).alias("host"), F.lit(depth).alias("depth"), F.lit(external).alias("external"), F.lit(not external).alias("fetched"),
            (zero if status is None else status).cast("int").alias("status_code"), F.lit("text/html").alias("content_type"), (F.lit("") if title is None else title).alias("title"),
            (F.lit("") if body is None else F.substring(F.sha2(body, 256), 1, 16)).alias("content_hash"), (no_techs if techs is None else techs).alias("techs"),
        )

    tech = F.array(F.struct(F.lit("nginx").alias("name"), F.when((k % 3 == 0) & F.lit(new), F.lit("1.1")).otherwise(F.lit("1.0")).alias("version")))
    title = F.concat(F.lit("Order "), k.cast("string"), F.when((k % 7 == 0) & F.lit(new), F.lit(" revised")).otherwise(F.lit("")))
    body = F.concat(F.when((k % 5 == 0) & F.lit(new), F.lit("p")).otherwise(F.lit("o")), k.cast("string"))
    nodes = node(kept, _url("order", "o_orderkey"), "page", 0, status=F.when((k % 11 == 0) & F.lit(new), 404).otherwise(200), title=title, body=body, techs=tech)
    nodes = nodes.unionByName(node(customers, _url("customer", "c_custkey"), "page", 1)).unionByName(node(nations, _url("nation", "n_nationkey"), "page", 2))
    nodes = nodes.unionByName(node(table(spark, sf_dir, "region"), _url("region", "r_regionkey"), "page", 3))
    nodes = nodes.unionByName(node(parts.select("l_partkey").distinct(), _url("part", "l_partkey"), "api", 1))
    nodes = nodes.unionByName(node(lines.select(supplier.alias("s")).distinct(), _supplier(F.col("s")), "script", 1, external=True))
    findings = kept.filter((k % 17 != 0) | F.lit(not new)).select(_url("order", "o_orderkey").alias("url"), F.lit("email").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("value"), F.lit("").alias("evidence"))
    if new:
        findings = findings.unionByName(kept.filter(k % 19 == 0).select(_url("order", "o_orderkey").alias("url"), F.lit("secret-like").alias("kind"), F.concat(F.lit("AKIA"), F.lpad(k.cast("string"), 16, "0")).alias("value"), F.lit("").alias("evidence")))
    return Crawl(nodes, edges, findings)


def crawl_sql(side: str = "all", p: str = "") -> str:
    """CTEs {p}nodes, {p}edges and {p}findings that equal crawl(side)."""
    new = side == "new"
    where = {"all": "true", "old": "o_orderdate < TIMESTAMP '2000-01-01'", "new": "o_orderdate >= TIMESTAMP '1996-01-01'"}[side]
    on = lambda test, a, b: f"CASE WHEN {test} THEN {a} ELSE {b} END" if new else b
    u = lambda kind, key: f"'{SITE}/{kind}/' || {key}"
    s = f"'https://s' || (l_suppkey + {int(new)}) || '.example.net/w.js'"
    rest = "'text/html' AS content_type"
    plain = f"{{k}} AS kind, 'shop.example.com' AS host, {{d}} AS depth, false AS external, true AS fetched, 200 AS status_code, {rest}, '' AS title, '' AS content_hash, [] :: STRUCT(name VARCHAR, version VARCHAR)[] AS techs"
    row = lambda kind, key, source, k, d: f"SELECT {u(kind, key)} AS url, {plain.format(k=repr(k), d=d)} FROM {source}"
    return f"""
        {p}o AS (SELECT o_orderkey AS k, o_custkey FROM orders WHERE {where}),
        {p}l AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT k FROM {p}o)),
        {p}edges AS (
            SELECT {u('order', 'k')} AS src_url, {u('customer', 'o_custkey')} AS dst_url, 'href' AS rel FROM {p}o
            UNION ALL SELECT {u('customer', 'c_custkey')}, {u('nation', 'c_nationkey')}, 'href' FROM customer
            UNION ALL SELECT {u('nation', 'n_nationkey')}, {u('region', 'n_regionkey')}, 'href' FROM nation
            UNION ALL SELECT DISTINCT {u('order', 'l_orderkey')}, {u('part', 'l_partkey')}, 'js-endpoint' FROM {p}l {'WHERE l_partkey % 13 <> 0' if new else ''}
            UNION ALL SELECT DISTINCT {u('order', 'l_orderkey')}, {s}, 'script' FROM {p}l),
        {p}nodes AS (
            SELECT {u('order', 'k')} AS url, 'page' AS kind, 'shop.example.com' AS host, 0 AS depth, false AS external, true AS fetched, {on('k % 11 = 0', '404', '200')} AS status_code, {rest},
                   'Order ' || k || {on('k % 7 = 0', "' revised'", "''")} AS title, left(sha256({on('k % 5 = 0', "'p'", "'o'")} || k), 16) AS content_hash,
                   [{{'name': 'nginx', 'version': {on('k % 3 = 0', "'1.1'", "'1.0'")}}}] AS techs FROM {p}o
            UNION ALL {row('customer', 'c_custkey', 'customer', 'page', 1)}
            UNION ALL {row('nation', 'n_nationkey', 'nation', 'page', 2)}
            UNION ALL {row('region', 'r_regionkey', 'region', 'page', 3)}
            UNION ALL {row('part', 'l_partkey', f"(SELECT DISTINCT l_partkey FROM {p}l {'WHERE l_partkey % 13 <> 0' if new else ''})", 'api', 1)}
            UNION ALL SELECT x AS url, 'script', regexp_extract(x, '://([^/]*)', 1), 1, true, false, 0, 'text/html', '', '', [] FROM (SELECT DISTINCT {s} AS x FROM {p}l)),
        {p}findings AS (
            SELECT {u('order', 'k')} AS url, 'email' AS kind, 'c' || o_custkey || '@example.com' AS value FROM {p}o {'WHERE k % 17 <> 0' if new else ''}
            {f"UNION ALL SELECT {u('order', 'k')}, 'secret-like', 'AKIA' || lpad(k::VARCHAR, 16, '0') FROM {p}o WHERE k % 19 = 0" if new else ''})"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text): texts with one of everything that the extractors look for, made of keys."""
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    pieces = [
        "db at 10.0.", (F.col("o_custkey") % 256).cast("string"), ".", (F.col("o_orderkey") % 256).cast("string"), ' see "/api/v1/', o, '" mail cust', c, "@mail.example.org, host dev.c", c,
        ".example.com and https://github.com/user", o, "/. from //bucket-", o, ".s3.eu-west-1.amazonaws.com/x or acct", c, ".blob.core.windows.net key AKIA", F.lpad(o, 16, "0"), " file build.test.js",
    ]
    # the keys are dealt out before the texts are made: one small file would be one task of long work
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(shuffle_partitions(spark))
    return keys.select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]).alias("text"))


TRACES = """t AS (SELECT o_orderkey, 'db at 10.0.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || ' see "/api/v1/' || o_orderkey || '" mail cust' || o_custkey || '@mail.example.org, host dev.c' || o_custkey ||
    '.example.com and https://github.com/user' || o_orderkey || '/. from //bucket-' || o_orderkey || '.s3.eu-west-1.amazonaws.com/x or acct' || o_custkey || '.blob.core.windows.net key AKIA' || lpad(o_orderkey::VARCHAR, 16, '0') || ' file build.test.js' AS text FROM orders)"""


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", canonical_url(F.col("url")).alias("canon"))
