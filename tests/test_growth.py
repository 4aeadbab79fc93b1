"""Shortest paths from both ends, growing components and histories against brute force."""

import random

from webloom.operators import diff, history, paths
from webloom.operators.components import connected_components, grow_components


def levels(edges, start):
    found, now = {start: 0}, [start]
    while now:
        now = sorted({b for a, b in edges if a in now and b not in found})
        found |= {b: max(found.values()) + 1 for b in now}
    return found


def test_two_ended_path(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (30, 60)):
        edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)}
        frame = spark.createDataFrame([(a, b, "href") for a, b in edges] + [(None, "n01", "href"), ("n01", None, "href"), ("n00", f"n{n - 1:02}", "image")], "src_url string, dst_url string, rel string")
        for dst in (f"n{n - 1:02}", "n05", "nowhere"):
            want = levels(edges, "n00").get(dst)
            got = paths.two_ended_path(frame, "n00", dst, ("href",))
            assert (len(got) - 1 if got else None) == want
            assert not got or (got[0] == "n00" and got[-1] == dst and set(zip(got, got[1:])) <= edges)
    assert paths.two_ended_path(frame, "n00", "n00") == ["n00"]


def test_a_long_path_and_its_smaller_side(spark):
    """A chain of 40 steps is walked in few jobs, and a hub at one end is not opened."""
    rows = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("c00", f"x{i}") for i in range(500)]
    stats: dict[str, int] = {}
    got = paths.two_ended_path(spark.createDataFrame([(*r, "href") for r in rows], "src_url string, dst_url string, rel string"), "c00", "c40", stats=stats)
    assert got == [f"c{i:02}" for i in range(41)]
    assert stats["forward_levels"] + stats["backward_levels"] == 40 and stats["forward_levels"] <= 2


def test_growing_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(90):02}", f"n{rng.randrange(90):02}") for _ in range(70)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    known = connected_components(frame(edges[:40]))
    for cut in (40, 55):
        more = edges[cut : cut + 15]
        before = {tuple(r) for r in known.collect()}
        known, changed = grow_components(known, frame([*more, (None, "n00"), ("n00", None), *more[:3]]))
        got = sorted(tuple(r) for r in known.collect())
        assert got == sorted(tuple(r) for r in connected_components(frame(edges[: cut + 15])).collect())
        assert {tuple(r) for r in changed.collect()} == set(got) - before
    same, changed = grow_components(known, frame(edges[:0]))
    assert sorted(map(tuple, same.collect())) == got and not changed.count()


def test_histories(spark):
    rng = random.Random(6)
    crawls = [{rng.choice("abcdefgh") + rng.choice("xy") for _ in range(7)} for _ in range(6)]
    frame = lambda s: spark.createDataFrame([(e[0], e[1], None) for e in s], "src_url string, dst_url string, rel string")
    stacked = spark.createDataFrame([(e[0], e[1], None, n) for n, s in enumerate(crawls) for e in [*s, *s]], "src_url string, dst_url string, rel string, crawl long")
    whole = history.intervals(stacked)
    grown = history.intervals(stacked.filter("crawl = 0"))
    for n in range(1, 6):
        grown = history.extend(grown, frame(crawls[n]), n)
    assert sorted(map(str, grown.collect())) == sorted(map(str, whole.collect()))
    for a in range(6):
        assert {r["src_url"] + r["dst_url"] for r in history.at(whole, a).collect()} == crawls[a]
    for a, b in ((0, 5), (2, 1), (3, 3), (1, 4)):
        got = {(r["src_url"] + r["dst_url"], r["change"]) for r in history.between(whole, a, b).collect()}
        assert got == {(e, "added") for e in crawls[b] - crawls[a]} | {(e, "removed") for e in crawls[a] - crawls[b]}
    for r in history.lifetimes(whole).collect():
        held = [n for n in range(6) if r["src_url"] + r["dst_url"] in crawls[n]]
        breaks = sum(b - a > 1 for a, b in zip(held, held[1:]))
        assert (r["first_seen"], r["last_seen"], r["crawls"], r["returns"]) == (held[0], held[-1], len(held), breaks)
    empty = history.intervals(stacked.limit(0))
    assert not empty.count() and not history.between(empty, 0, 1).count()
    assert diff.EDGE == ("src_url", "dst_url", "rel")
