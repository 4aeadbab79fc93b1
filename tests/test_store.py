"""The store's commits: two writers at once, writers that die, work that is saved once, counts without further scans."""

import json
import os
import random
import threading
from datetime import datetime, timezone

import pytest

from webloom.sources.commits import CommitLog, Conflict
from webloom.sources.store import BLOCKED, Store

NODE = "url string, kind string, depth int, external boolean, fetched boolean, status_code int, error string"
EDGE = "src_url string, dst_url string, rel string, context string"
FINDING = "url string, kind string, value string, evidence string"
WHEN = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def tables(spark):
    nodes = [("a", "page", 0, False, True, 200, ""), ("b", "page", 1, False, True, 404, ""), ("c", "page", 1, False, True, 200, None)]
    nodes += [("d", "page", 1, False, False, 0, BLOCKED), ("e", "page", 1, False, True, 0, "timed out"), ("f", "page", 1, True, False, None, None)]
    edges = [("a", "b", "href", ""), ("a", "c", "href", "")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([], FINDING)


def test_two_writers_of_one_second(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path))
    ids, wait = [], threading.Barrier(3)

    def save():
        wait.wait()
        ids.append(store.save(*tables, "https://a.test/", finished_at=WHEN))

    writers = [threading.Thread(target=save) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    base = "20240506T070809Z_a.test"
    assert sorted(ids) == [base, f"{base}-2", f"{base}-3"] == sorted(r["crawl_id"] for r in store.list().collect())
    assert len({r["folder"] for r in store.list().collect()}) == 3
    assert all(store.load(i)[0].count() == 6 for i in ids)
    assert store.log.last() == 3


def test_a_commit_is_never_written_over(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"), "k string, v int", "k")
    assert log.create(1, {"k": "a", "v": 1, "version": 1}) and not log.create(1, {"k": "b", "v": 2, "version": 1})
    assert json.loads((tmp_path / "log" / f"{1:020d}.json").read_text())["k"] == "a"
    assert os.listdir(tmp_path / "log") == [f"{1:020d}.json"]
    # another commit comes between reading the state and writing, twice
    seen = []

    def slow(state):
        seen.append(state.count())
        if len(seen) < 3:
            log.create(len(seen) + 1, {"k": f"other{len(seen)}", "v": 0, "version": len(seen) + 1})
        return {"k": "mine", "v": len(seen)}

    assert log.append(slow)["v"] == 3 and seen == [1, 2, 3] and log.last() == 4
    with pytest.raises(Conflict):
        log.append(lambda state: log.create(log.last() + 1, {"k": "x"}) and {"k": "never"}, tries=2)


def test_later_entries_replace_and_checkpoints_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("webloom.sources.commits.CHECKPOINT_EVERY", 4)
    log = CommitLog(spark, str(tmp_path), "k string, v int", "k")
    for n in range(9):
        log.append(lambda state, n=n: {"k": f"k{n % 3}", "v": n} if n != 8 else {"k": "k0", "removed": True})
    want = [("k1", 7, 8), ("k2", 5, 6)]
    assert sorted(map(tuple, log.state().collect())) == want
    assert sorted(map(tuple, log.state(8).collect())) == [("k0", 6, 7), *want]
    log.clean_up()
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == [f"{8:020d}.checkpoint", f"{9:020d}.json"]
    assert sorted(map(tuple, log.state().collect())) == want
    log.append(lambda state: {"k": "k0", "v": 10})
    assert log.last() == 10 and log.state().count() == 3


def test_a_writer_that_dies_shows_nothing(spark, tables, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    nodes, edges, _ = tables
    broken = spark.range(1).selectExpr("raise_error('gone') as url")
    with pytest.raises(Exception, match="gone"):
        store.save(nodes, edges, broken, "https://a.test/", finished_at=WHEN)
    with monkeypatch.context() as m:  # all is written, the commit is not
        m.setattr(CommitLog, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.save(*tables, "https://a.test/", finished_at=WHEN)
    assert store.list().count() == 0 and len(os.listdir(tmp_path / "crawls")) == 2
    kept = store.save(*tables, "https://a.test/", finished_at=WHEN)
    assert kept == "20240506T070809Z_a.test"
    assert store.vacuum() == 0  # too young: a job may still be at it
    assert store.vacuum(older_than_hours=-1) == 2
    assert store.load(kept)[0].count() == 6
    store.remove(kept)
    assert store.list().count() == 0
    with pytest.raises(KeyError):
        store.load(kept)
    with pytest.raises(KeyError):
        store.remove(kept)
    assert store.vacuum(older_than_hours=-1) == 1 and os.listdir(tmp_path / "crawls") == []


def test_work_that_is_saved_once(spark, tables, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    first = store.save(*tables, "https://a.test/", once="batch 7")
    assert store.save(*tables, "https://a.test/", once="batch 7") == first
    assert store.save(*tables, "https://a.test/", once="batch 8") != first
    # the same work at the same time: both find nothing at first, one commits
    ids, wait = [], threading.Barrier(2)
    saved = Store._saved
    calls = []

    def both_see_nothing(state, once):
        if len(calls) < 2:
            calls.append(1)
            return None
        return saved(state, once)

    monkeypatch.setattr(Store, "_saved", staticmethod(both_see_nothing))

    def save():
        wait.wait()
        ids.append(store.save(*tables, "https://a.test/", once="batch 9"))

    writers = [threading.Thread(target=save) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(set(ids)) == 1 and store.list().count() == 3
    assert len(os.listdir(tmp_path / "crawls")) == 3


def test_counts_come_from_the_jobs_that_write(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path))
    group = "counting"
    spark.sparkContext.setJobGroup(group, "save")
    try:
        crawl_id = store.save(*tables, "https://a.test/", finished_at=WHEN)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one to make the id, three that write, and what reads the (empty) log
    assert len(jobs) <= 8
    got = {r["what"]: r["n"] for r in store.stats(crawl_id).collect()}
    assert got == {"nodes": 6, "edges": 2, "findings": 0, "pages": 3, "errors": 1, "blocked": 1, "external": 1, "status 200": 2, "status 404": 1}
    head = store.head(crawl_id)
    assert head["target"] == "https://a.test/" and head["finished_at"].replace(tzinfo=timezone.utc) == WHEN


@pytest.mark.parametrize("options", [{}, {"ignore_findings": True}, {"ignore_content": True}])
def test_rules_are_counted_a_table_at_a_time(spark, options):
    """The counts of the whole diff, from crawls with null, repeated and shared rows, with no shuffle of all classes at once."""
    from webloom.operators import diff

    kinds = [None, "email", "secret-like", "secret"]
    node = "url string, host string, external boolean, status_code int, content_type string, title string, content_hash string, techs array<struct<name:string,version:string>>"

    def side(seed):
        dice = random.Random(seed)
        urls = [f"u{n}" for n in range(40) if dice.random() < 0.7]
        nodes = [(u, f"h{dice.randrange(9)}", dice.random() < 0.4, dice.choice([200, 404, None]), None, dice.choice(["x", None]), dice.choice(["a", "b", ""]), [("t", dice.choice(["1", None]))]) for u in urls]
        edges = [(dice.choice(urls), dice.choice(urls), dice.choice("ab")) for _ in range(90)]
        findings = [(dice.choice(urls), dice.choice(kinds[1:]), dice.choice("xyz")) for _ in range(30)]
        return diff.Crawl(spark.createDataFrame(nodes, node), spark.createDataFrame(edges * 2, "src_url string, dst_url string, rel string"), spark.createDataFrame(findings, "url string, kind string, value string"))

    old, new = side(1), side(2)
    chosen = diff.DiffOptions(**options)
    want = [tuple(r) for r in diff.rule_counts(diff.diff(old, new, chosen)).collect()]
    for parts, waves in ((0, 1), (3, 4)):
        assert [tuple(r) for r in diff.count_rules(old, new, chosen, parts, waves).collect()] == want
    assert dict(want)["restructured"] and dict(want)["changed"]
    # an edge with a null field in both crawls is no change, as in SQL
    loose = spark.createDataFrame([("u1", None, "a")], "src_url string, dst_url string, rel string")
    more = diff.count_rules(diff.Crawl(old.nodes, old.edges.unionByName(loose), old.findings), diff.Crawl(new.nodes, new.edges.unionByName(loose), new.findings), chosen)
    assert [tuple(r) for r in more.collect()] == want


def test_rule_counts_come_with_the_written_diff(spark, tmp_path):
    from webloom.operators import diff
    from webloom.plans.demo import crawl

    sf = "/root/testdata/sf0.001"
    for options in (diff.DiffOptions(), diff.DiffOptions(ignore_findings=True)):
        changes = diff.diff(crawl(spark, sf, "old"), crawl(spark, sf, "new"), options)
        path = f"{tmp_path}/{options.ignore_findings}"
        spark.sparkContext.setJobGroup("diff", "diff")
        try:
            got = diff.write_diff(changes, path)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == {r["rule"]: r["n"] for r in diff.rule_counts(changes).collect()} and got["any"] > 0
        assert spark.read.parquet(f"{path}/changed").count() == got["changed"] and sorted(os.listdir(path)) == sorted(changes)
