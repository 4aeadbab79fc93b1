"""Steps whose tasks must not grow with the tables: parts, buckets and batches."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import html
from webloom.operators import diff, history
from webloom.plans import demo
from webloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(demo, "PART_LINES", 300)
    n = demo.row_parts(spark, SF)
    assert n >= 19
    return n


def test_no_url_is_shuffled_to_make_a_crawl(spark, small_parts):
    got = plan(demo.crawl(spark, SF, "new").edges)
    moved = [line for line in got.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("_url" not in line and f", {small_parts})" in line for line in moved if "l_orderkey" in line or "_url" in line)
    assert not any("concat" in line or "_url" in line for line in moved)


@pytest.mark.parametrize("name", ["diff_edges", "edge_lifetimes", "history_changed", "history_edges"])
def test_parts_grow_with_the_lines(spark, small_parts, name):
    assert f", {small_parts}), REPARTITION_BY_NUM" in "".join(x for x in plan(QUERIES[name](spark, SF)).splitlines() if "src_url" in x or "techs" in x)


@pytest.mark.parametrize("name", ["stored_hubs"])
def test_buckets_grow_with_the_lines(spark, small_parts, name):
    assert "Bucketed: true" in plan(QUERIES[name](spark, SF)) and f"out of {small_parts}" in plan(QUERIES[name](spark, SF))


def test_parts_make_no_difference(spark):
    rows = [[(f"s{i % 7}", f"d{i % 11}", "href") for i in range(k, k + 40)] for k in (0, 13, 29)]
    crawls = [diff.Crawl(None, spark.createDataFrame(r, "src_url string, dst_url string, rel string"), None) for r in rows]
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(history.edge_history(crawls), history.edge_history(crawls, 5))
    assert same(diff.changed_edges(crawls[0].edges, crawls[1].edges), diff.changed_edges(crawls[0].edges, crawls[1].edges, 5))


def test_pages_come_in_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key in keys:
        spark.conf.unset(key)
    spark.range(1).select(html.parse_html(F.lit("<p>")))
    assert int(spark.conf.get(keys[0])) <= 500 and spark.conf.get(keys[1]) == "4m"
