from datetime import datetime

from pyspark.sql import functions as F

from webloom.__main__ import main
from webloom.functions.responses import fetch_schedule, retry_after_seconds, retryable_status
from webloom.operators.build import RESPONSES


def test_two_versions_of_a_site(spark, tmp_path, capsys):
    for n, body in enumerate(("<a href='/about'>a</a><a href='/old'>o</a>", "<a href='/about'>a</a><a href='/new'>n</a><script src='/app.js'></script>")):
        rows = [("https://a.test/", 0, "page", None, [], 200, {"content-type": ["text/html"]}, body, None), ("https://a.test/app.js", 0, "page", None, [], 200, {"content-type": ["text/javascript"]}, "fetch('/api/v1/x')", None)]
        spark.createDataFrame(rows, RESPONSES).write.parquet(str(tmp_path / f"r{n}"))
    store = ["--store", str(tmp_path / "store")]
    ids = []
    for n in range(2):
        assert main([*store, "crawl", str(tmp_path / f"r{n}"), "--seed", "https://a.test"]) == 0
        ids.append(capsys.readouterr().out.split()[-1])
    assert main([*store, "query", "latest", "path-to", "/api/v1/x"]) == 0
    assert capsys.readouterr().out.split() == ["https://a.test/", "https://a.test/app.js", "https://a.test/api/v1/x"]
    assert main([*store, "query", ids[0], "summary"]) == 0
    assert main([*store, "diff", *ids, "--fail-on", "appeared"]) == 2
    assert "https://a.test/new" in capsys.readouterr().out
    assert main([*store, "diff", *ids, "--fail-on", "new-secret"]) == 0
    assert main([*store, "diff", ids[0], ids[0]]) == 1
    assert main([*store, "list"]) == 0 and main(["version"]) == 0


def test_retries_and_schedule(spark):
    codes = spark.createDataFrame([(c,) for c in (200, 408, 429, 500, 501, 503)], "c int").coalesce(1)
    assert [r[0] for r in codes.select(retryable_status(F.col("c"))).collect()] == [False, True, True, True, False, True]
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    rows = spark.createDataFrame([("120",), ("Mon, 01 Jan 2024 00:01:00 GMT",), ("soon",), (None,), ("-5",)], "v string").coalesce(1)
    assert [r[0] for r in rows.select(retry_after_seconds(F.col("v"), now)).collect()] == [120.0, 60.0, 0.0, 0.0, 0.0]
    requests = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(3)], "host string, seq int")
    delays = spark.createDataFrame([("b", 5.0)], "host string, delay_s double")
    got = sorted((r["host"], r["seq"], r["start_s"]) for r in fetch_schedule(requests, 2.0, 4, delays).collect())
    assert [s for h, _, s in got if h == "a"] == [0, 0, 0, 0, 0.5, 1.0] and [s for h, _, s in got if h == "b"] == [0, 5, 10]
