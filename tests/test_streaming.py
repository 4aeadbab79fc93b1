from webloom.functions.scope import ScopeRules
from webloom.operators.build import RESPONSES
from webloom.sources.store import Store
from webloom.streaming.ingest import ingest_crawls, stream_responses, windowed_counts


def test_each_batch_is_a_crawl(spark, tmp_path):
    rows = [("https://a.test/", 0, "page", None, [], 200, {"content-type": ["text/html"]}, "<title>A</title><a href='/b'>b</a>", None)]
    spark.createDataFrame(rows, RESPONSES).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_crawls(stream_responses(spark, str(tmp_path / "in")), store, ScopeRules(("a.test",)), "https://a.test", str(tmp_path / "checkpoint")).awaitTermination()
    crawls = store.list("a.test").collect()
    assert [(c["label"], c["nodes"], c["edges"]) for c in crawls] == [("batch-0", 2, 1)]


def test_windows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    found = windowed_counts(events, "ts", "event_type")
    assert found.agg({"n": "sum"}).first()[0] == events.count()
