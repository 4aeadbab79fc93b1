"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, and brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import minhash, mixing, quality, sharding, topk, urlrules
from webloom.llm.queries import HOST_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(spark, rows, schema):
    """A table with further columns named like those that operators use inside."""
    frame = spark.createDataFrame(rows, schema)
    for name in ("size", "rank", "target", "source_size", "bucket", "component", "score", "shard", "slot", "upto", "_id", "id", "host", "token", "rule", "v", "g"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit("x"))
    return frame


def documents(seed=1, n=120):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 5, 20, 80]))), rng.choice(["a", "B", "ä", None, "c"])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (n + 2, "word " * 20_000, "c"), (n + 3, rows[3][1], "a"), (3, rows[3][1], rows[3][2]), (None, "no id", "a"), (None, "no id", "a")]


SCHEMA = "doc_id long, text string, source string"


def test_mix(spark):
    rows = documents()
    mix = mixing.mix_sources(clashing(spark, rows, SCHEMA)).collect()
    assert len(mix) == len(rows)
    sizes, got, targets = {}, {}, {}
    for r in mix:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
    for _, t, s in rows:
        sizes[s] -= len(WORD.findall(t or ""))
    assert not any(sizes.values())
    own = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in got}
    weights = dict(zip(sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None], [3, 1, 2, 3, 1]))
    want, left, open_ = {}, 1.5 * sum(own.values()), set(own)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * own[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * own[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    largest = {s: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in own}
    for s in own:
        assert targets[s] == pytest.approx(want[s])
        assert 0 <= targets[s] - got[s] <= largest[s]
    again = mixing.mix_sources(clashing(spark, rows, SCHEMA).repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in mix)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0



@pytest.mark.parametrize("seed", [1, 20240607])
def test_mix_closes_the_gap_of_small_sources(spark, seed):
    """Sources of few documents end within 1% of their targets, or a smallest document, of the best that whole documents can reach."""
    rng = random.Random(seed)
    rows = []
    for source in range(12):
        sizes = [rng.choice([3, 40, 400, 4000]) + rng.randrange(40) for _ in range(6 + 4 * source)]
        rows += [(len(rows) + i, "w " * n, f"s{source:02}") for i, n in enumerate(sizes)]
    got, sizes, target = {}, {}, {}
    for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(3, 5, 2), share=0.95, max_repeat=1.4, seed=seed).collect():
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        sizes.setdefault(r["source"], []).append(r["size"])
        target[r["source"]] = r["target"]
    for s, t in target.items():
        certain = math.floor(t / sum(sizes[s])) * sum(sizes[s])
        sums = 1  # bit n: some of the documents have n words together
        for n in sizes[s]:
            sums |= sums << n
        best = certain + (sums & ((1 << (math.floor(t - certain) + 1)) - 1)).bit_length() - 1
        assert got[s] <= t and best - got[s] <= max(0.01 * t, min(sizes[s])), s


def test_drawn_documents_are_the_least_of_their_class_and_rates_are_the_chances(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.choice([10, 11, 40, 45, 47, 300])), rng.choice("ab")) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    hits, chances, sizes, seeds = {}, {}, {}, 6
    for seed in range(seeds):
        mix = mixing.mix_sources(docs, (2, 1), 0.5, seed=seed).collect()
        per = {}
        for r in mix:
            hits[r["doc_id"]] = hits.get(r["doc_id"], 0) + r["drawn"]
            chances[r["doc_id"]], sizes[r["doc_id"]] = r["chance"], (r["source"], math.floor(4 * math.log2(r["size"])))
            per[sizes[r["doc_id"]]] = per.get(sizes[r["doc_id"]], 0) + r["drawn"]
        if seed == 0:
            fixed = per
        assert per == fixed  # as many of each class whatever the seed
    assert len(set(round(c, 6) for c in chances.values())) > 6
    error = [hits[i] / seeds - chances[i] for i in hits]
    assert abs(sum(error) / len(error)) < 0.03 and math.sqrt(sum(e * e for e in error) / len(error)) < 0.25
    for c in set(sizes.values()):  # sums of chances are the numbers drawn
        assert abs(sum(chances[i] for i in hits if sizes[i] == c) - fixed[c]) < 0.6
    big, small = [i for i in hits if rows[i][1].count("w") == 11], [i for i in hits if rows[i][1].count("w") == 10]
    assert min(chances[i] for i in big if rows[i][2] == "a") > max(chances[i] for i in small if rows[i][2] == "a") or sizes[big[0]] != sizes[small[0]]


def test_shards_are_minimax(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUMMARY_ROWS", 40)  # so that ranges are refined again and again
    rows = documents(2, 300)
    got = sharding.shard_by_bytes(clashing(spark, rows, SCHEMA), 12).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        key = t or ""
        first, size = groups.get(key, (10**9, 0))
        groups[key] = min(first, 10**9 if i is None else i), size + len(key.encode()) + 16
    order = [size for _, size in sorted(groups.values())]

    def shards(capacity):
        n, held = 1, 0
        for size in order:
            if held + size > capacity:
                n, held = n + 1, 0
            held += size
        return n

    best = next(c for c in range(max(order), sum(order) + 1) if shards(c) <= 12)
    sizes, slots, of = {}, {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert max(sizes.values()) == best and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert {r["text_crc32"] for r in got} == {zlib.crc32((t or "").encode()) for _, t, _ in rows}
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_rules(spark):
    rng = random.Random(3)
    pool = ["http://example.com/en/", "https://www.example.com/en/a", "http://EXAMPLE.com", "http://notexample.com/en/", "https://a.net/es/x?y#z", "ftp://b.net/fr/", "https://net/fr/", "x.com/en/", "", None, "http://h.org/login?x", "http://h.org/a?sid=1", "https://a.com:80/", "http://h.org/loginx", "//a.com/", "a://b://com/"]
    rows = [(i, rng.choice(pool)) for i in range(60)] + [(None, "http://example.com/en/"), (5, "http://h.org/f.exe")] * 2 + [(99, "http://a.com/" + "x" * 50_000)]
    got = urlrules.filter_urls(clashing(spark, rows, "page_id long, url string"), HOST_RULES + urlrules.DEFAULT_PATTERNS).collect()
    assert len(got) == len(rows)
    for r in got:
        u = r["url"] or ""
        host, path = "", ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [x for x in HOST_RULES if (host == x.name.split("/")[0] or host.endswith("." + x.name.split("/")[0])) and path.startswith(x.name[x.name.index("/") :])]
        best = max(fits, key=lambda x: len(x.name), default=None)
        blocked = any(re.search(x.pattern, u.lower()) for x in urlrules.DEFAULT_PATTERNS)
        assert (r["host"], r["path"]) == (host, path)
        assert r["verdict"] == (best.verdict if best else "block" if blocked else "allow") and (not best or r["rule"] == best.name)
    assert urlrules.filter_urls(spark.createDataFrame([], "page_id long, url string"), HOST_RULES).count() == 0
    assert urlrules.host_rule("block", "a.com/en").tokens == ("a", "com") and urlrules.host_rule("block", "a.com/En/").tokens == ("a", "com")


def test_many_url_rules(spark, monkeypatch):
    rules = [urlrules.host_rule("block" if i % 3 else "allow", f"s{i}.com/{'x/' if i % 2 else ''}") for i in range(10_000)]
    urls = [f"http://{'www.' if i % 2 else ''}s{7 * i}.com/{'x/y' if i % 3 else 'z'}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_name = {r.name: r for r in rules}
    for bound in (50_000, 100):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", bound)
        for r in urlrules.filter_urls(frame, tuple(rules)).collect():
            i = 7 * r["page_id"]
            best = by_name.get(f"s{i}.com/") or (by_name.get(f"s{i}.com/x/") if r["path"].startswith("/x/") else None)
            assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow"))
    assert {(r["rule"], r["verdict"]) for r in urlrules.filter_urls(frame, ()).collect()} == {(None, "allow")}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROWS", 3)  # so that buckets are dealt to several salts
    rng = random.Random(4)
    base = [f"w{rng.randrange(999)}" for _ in range(40)]
    rows = [(i, " ".join(base[:k] + [f"x{rng.randrange(9)}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(40), k=60))]
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One  two"), (104, "one"), (105, "a " * 9000), (106, "a b " * 9000), (None, "one two"), (7, rows[7][1]), (107, " ".join(f"y{i}" for i in range(3000)))]
    p = minhash.MinHash(words=3)
    got = minhash.near_duplicates(clashing(spark, rows, "doc_id long, text string"), p).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets if i is not None}
    for a in root:
        for b in root:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {n: x if r == y else r for n, r in root.items()}
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == (None if r["doc_id"] is None else root[r["doc_id"]]) and r["kept"] == (r["doc_id"] is not None and root[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), p).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choices(["the", "house", "stands", "here", "and", "there", "quietly"], k=40)) + "."
    bad = lambda: "$$$ ".join(rng.choices(["WIN", "CASH", "NOW", "FREE"], k=40))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(200)] + [(1000, None), (1001, ""), (1002, "x" * 100_000), (None, "the house stands"), (3, "the house")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = clashing(spark, rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels, max_rows=150).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == len(rows) - 1
    assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i]["predicted"] == int(i % 5 != 0) for i in range(200) if i != 3)
    assert {r["predicted"] for r in quality.score_quality(docs, labels.filter("quality = 0")).collect()} == {0}
    assert {r["predicted"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {1}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 64]) for i in range(260)]
    rows += [(300, None), (350, [1.0] * 5 + [None]), (400, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (500, [0.0] * 6), (550, [1.0]), (551, [2.0]), (552, []), (600, []), (650, [9e6, 1.0] + [0.0] * 4), (651, [3e30] + [1.0] * 5), (None, [1.0] * 6), (50, rows[50][1])]
    table = clashing(spark, rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in topk.top_k(table, k=5, pivots=4).select("query_id", "rank", "vec_id", "score").collect()]
    use = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and i not in (300, 350, 400, 450)}
    want = []
    for q in use:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(use[q], v)), i) for i, v in use.items() if i != q and len(v) == len(use[q]))[:5]
            want += [(q, n + 1, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).count() == 1


def test_pivots_skip_most_candidates():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-5, 5, (500, 8)) + 100 * np.eye(8, dtype=int)[c] for c in range(8)])
    pivots = x[[0, 600, 1100, 1600, 2100, 2600, 3100, 3600]].astype(float)
    far = lambda a: np.sqrt(((a[:, None, :] - pivots[None]) ** 2).sum(axis=2))
    ids = np.arange(len(x))
    _, _, scores, products = topk.best_of_cell(ids[:40], x[:40], far(x[:40]), ids, x, far(x), 5)
    assert products < 0.5 * 40 * len(x)
    full = x[:40] @ x.T
    np.fill_diagonal(full[:, :40], -(10**9))
    assert scores == [s for row in full for s in sorted(row.tolist(), reverse=True)[:5]]


def test_url_rules_of_equal_length_tie_by_name(spark):
    rules = (urlrules.token_rule("bb", "block", "", "x", ""), urlrules.token_rule("aa", "allow", "", "y", ""), urlrules.token_rule("ccc", "block", "", "z", ""))
    frame = spark.createDataFrame([(1, "http://h/x/y"), (2, "http://h/y/x/z"), (3, "http://h/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.filter_urls(frame, rules).collect()}
    assert got == {1: ("aa", "allow"), 2: ("ccc", "block"), 3: ("bb", "block")}
