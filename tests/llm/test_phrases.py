"""Collocations against counts of every phrase in Python."""

import random
import re
from collections import Counter

import pytest

from webloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_phrase(rows, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def by_definition(rows, least, most, percent, top):
    f, n = every_phrase(rows, most)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in candidates.items():
        if any(
            lang == other_lang and len(o) > len(p) and 100 * b >= percent * a and any(o[i : i + len(p)] == p for i in range(len(o) - len(p) + 1))
            for (other_lang, o), b in candidates.items()
        ):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang in n:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in found if x[0] == lang)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, size=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "É", "über", "x y", " "]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "?! ", "\r\n"]
    rows = [("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""])) for _ in range(size)]
    return [*rows, (None, "en"), ("", None), ("...", "zz"), ("new york city " * 40, "fr"), ("new york city " * 40, "fr")]


@pytest.mark.parametrize(("seed", "least", "most", "percent", "top"), [(1, 10, 3, 50, 2000), (2, 5, 4, 30, 7), (3, 10, 2, 50, 3), (4, 2, 5, 100, 2000)])
def test_against_definition(spark, seed, least, most, percent, top):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = phrases.collocations(docs, least, most, percent, top)
    assert sorted(map(tuple, got.collect())) == by_definition(rows, least, most, percent, top)


def test_a_full_sketch_loses_nothing(spark):
    """With so few counters that every phrase survives, in several slices and flushes, the counts are the same."""
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = by_definition(rows, 10, 3, 50, 2000)
    for shape in (phrases.Shape(1 << 6, 1 << 4, 500, 50), phrases.Shape(1 << 16, 1 << 13)):
        assert sorted(map(tuple, phrases.collocations(docs, shape=shape).collect())) == want


def test_the_sketch_keeps_rare_phrases_out(spark):
    rng = random.Random(3)
    rows = [(" ".join(str(rng.randint(0, 10**9)) for _ in range(200)), "en") for _ in range(50)] + [("often seen", "en")] * 10
    small = spark.createDataFrame(rows, "text string, lang string")
    files = phrases.sketch(small, 10, 3, phrases.Shape(1 << 18), "und")
    import pyarrow as pa

    table = phrases._survivors(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), "und", 3, files, phrases.Shape(1 << 18))
    assert {(r["phrase"], r["f"]) for r in table.to_pylist() if r["words"]} == {("often", 10), ("seen", 10), ("often seen", 10)}


def test_odd_tables(spark):
    docs = spark.createDataFrame([("a b. " * 10, 1, "clash")], "body string, tongue int, phrase string")
    got = phrases.collocations(docs, text_col="body", lang_col="tongue").collect()
    assert [tuple(r) for r in got] == [("1", 1, "a b", 10, 10, 10, 20, 10**6)]
    assert phrases.collocations(docs.limit(0), text_col="body", lang_col="tongue").count() == 0
    assert phrases.collocations(docs, text_col="body", lang_col="tongue", top=None).count() == 1


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([(10**14, 3 * 10**14, 10**14 + 7)], "a long, l long, r long")
    assert counts.select(phrases.score_expr()).first()[0] == 10**6 * 10**28 // (3 * 10**14 * (10**14 + 7))
