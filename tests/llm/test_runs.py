"""Runs of repeated words against a search for every period, and the query against its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from webloom.llm import queries
from webloom.llm.runs import collapse_runs, find_runs, repeating

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(words, min_length, min_exponent):
    """All runs by start and period, by comparing each word with the one a period later."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and words[y] == words[y + q]:
                y += 1
            length = y - x + q
            smallest = not any(all(words[x + t] == words[x + t + d] for t in range(length - d)) for d in range(1, q))
            if y > x and length >= max(min_length, min_exponent * q) and smallest:
                found.append((x, length, q))
            x = max(y, x + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n = rng.randint(0, 60)
    words = [rng.randint(1, rng.randint(1, 4)) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 3))
        words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
    if rng.random() < 0.3:  # squares whose first place is in a shorter run than a later one
        words = words + words[: rng.randint(0, n)] + words
    return words


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def found_runs(docs, min_length, min_exponent):
    words = np.array([w for d in docs for w in d], dtype=np.int64)
    first = np.cumsum([0, *map(len, docs)])
    return list(zip(*(c.tolist() for c in find_runs(words, first, min_length, min_exponent)), strict=True))


@pytest.mark.parametrize("seed", range(60))
def test_all_runs_of_random_documents(seed):
    rng = random.Random(seed)
    docs = [random_words(rng) for _ in range(rng.randint(0, 6))]
    for limits in ((2, 2), (4, 2), (6, 3), (24, 3), (1, 4)):
        assert found_runs(docs, *limits) == [(i, *r) for i, d in enumerate(docs) for r in every_run(d, *limits)], limits


@pytest.mark.parametrize("words", [fibonacci(200), [1] * 90, [1, 2] * 40 + [2, 1] * 40, [1, 2, 3] * 9 + [1] + [1, 2, 3] * 12], ids=["fibonacci", "one word", "turned", "two runs"])
def test_all_runs_of_repetitive_documents(words):
    for limits in ((2, 2), (24, 3)):
        assert found_runs([words, words[::-1]], *limits) == [(i, *r) for i, d in enumerate((words, words[::-1])) for r in every_run(d, *limits)]


def test_a_long_run_in_a_long_document():
    rng = random.Random(5)
    words = [rng.randint(1, 10**6) for _ in range(60_000)]
    words[20_000:] = [words[20_000 + i % 9_000] for i in range(40_000)]
    assert found_runs([[7] * 10, words], 24, 3) == [(1, 20_000, 40_000, 9_000)]


def test_documents_without_a_repeated_stretch_end_early():
    words = np.array([*range(40), *range(16), 99, *range(16)], dtype=np.int64)
    assert repeating(words, np.array([0, 40, 40, 73]), 16).tolist() == [2]
    assert repeating(words, np.array([0, 56, 73]), 16).tolist() == [0]


def contract(doc_id, text):
    """The query's row by its definition."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = every_run(words, 24, 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    runs = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(runs), sha(kept))


def test_query_against_its_definition(spark, tmp_path):
    rng = random.Random(2)
    tails = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", "  \t\n ", "one", "A a A a " * 20, "x y z\u0000 \x0b" * 30, "ein Wort "]
    texts += [" ".join(rng.choice(["a", "b", "É", "dd"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    rows = [(d, t, "clash", 1) for d, t in zip([*tails[: len(texts) // 2], *range(3000, 3100)], texts, strict=False)]
    rows += rows[5:7]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_tandem_runs(spark, str(tmp_path)).collect()]
    want = [contract(*r[:2]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b " * 12), ("x", None), ("x", "a b " * 12 + "c")], "name string, body string")
    got = sorted((r["name"] or "", [tuple(x) for x in r["runs"]], r["collapsed"]) for r in collapse_runs(docs, id_col="name", text_col="body").collect())
    assert got == [("", [(0, 24, 2)], "a b"), ("x", [], ""), ("x", [(0, 24, 2)], "a b c")]
    assert collapse_runs(docs.limit(0), id_col="name", text_col="body").count() == 0
    with pytest.raises(ValueError):
        collapse_runs(docs, min_exponent=1)
