import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import decontam
from webloom.llm.words import PLAIN, Words


def texts(rng, n, size):
    vocabulary = [f"w{i}" for i in range(300)]
    return [" ".join(rng.choices(vocabulary[:30], k=size) if rng.random() < 0.3 else rng.choices(vocabulary, k=size)) + "." for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_block_max_finds_what_plain_bm25_finds(threshold):
    rng = random.Random(1)
    items = texts(rng, 37, 20) + texts(rng, 20, 40)
    index = decontam.Index.build(list(range(len(items))), items)
    docs = [" ".join(rng.sample(items, 2) + texts(rng, 1, rng.randrange(1, 500))) for _ in range(30)] + ["", "w1"]
    words = Words(pa.array(docs), letters=PLAIN)
    got = {(int(t), int(p), int(i)): s for t, p, i, s in zip(*index.retrieve(words, threshold), strict=True)}
    want = {}
    for t in range(len(docs)):
        own = words.hashes[words.first[t] : words.first[t + 1]]
        for p in range(-(-len(own) // index.stride)):
            held = set(own[p * index.stride : (p + 2) * index.stride].tolist())
            for i in range(len(items)):
                score = sum(
                    index.item_impact[r] for k in range(len(index.terms)) if int(index.terms[k]) in held for r in range(index.item_first[k], index.item_first[k + 1]) if index.item_of[r] == i
                )
                if score >= threshold - 1e-9:
                    want[t, p, i] = score
    assert got.keys() == want.keys() and want
    assert all(np.isclose(got[k], want[k]) for k in want)


def test_leaks(spark):
    rng = random.Random(2)
    items = texts(rng, 30, 25)
    items[0] = " ".join(f"a{i}" for i in range(20)) + ". " + " ".join(f"b{i}" for i in range(6)) + "."
    clean = texts(rng, 1, 400)[0]
    upper = items[0].upper().replace(" ", "  ")
    rows = [(1, clean, 0), (2, clean + " " + items[3] + " " + clean, 0), (3, upper, 0), (4, items[0].split(".")[0], 0), (5, None, 0), (6, "", 0), (2, items[3], 0), (7, " ".join([clean] * 50 + [items[5]]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "w1 w2"), (3, items[3])], "item_id long, text string")
    got = sorted(map(tuple, decontam.find_leaks(docs, bench).select("doc_id", "item_id").collect()))
    assert got == [(2, 3), (2, 3), (3, 0), (7, 5)]
    assert sorted(r["doc_id"] for r in decontam.drop_leaks(docs, bench).collect()) == [1, 4, 5, 6]
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.drop_leaks(docs, bench).columns == docs.columns
    assert sorted(r["doc_id"] is None for r in decontam.drop_leaks(docs.withColumn("doc_id", F.lit(None).cast("long")), bench).collect()) == [True] * 4


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(3)
    items = texts(rng, 40, 25) + [t for n in (66, 70, 81, 96, 100, 115, 127, 128, 129, 150) for t in texts(rng, 2, n)]
    docs = spark.createDataFrame([(i, " ".join(texts(rng, 1, 60) + [t] + texts(rng, 1, 60))) for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(map(tuple, decontam.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "CELLS", 10)
    for most in (1, 7):
        monkeypatch.setattr(decontam, "MAX_ITEMS", most)
        many = sorted(map(tuple, decontam.find_leaks(docs, bench).collect()))
        assert [r[:2] for r in one] == [r[:2] for r in many] and np.allclose([r[2:] for r in one], [r[2:] for r in many])
    assert [r[:2] for r in one] == [r[:2] for r in many] and {(i, i) for i in range(60)} <= {r[:2] for r in one}


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(4)
    items = texts(rng, 20, 30)
    half = lambda t: " ".join(t.split()[: rng.randrange(10, 30)])
    docs = [" ".join(texts(rng, 1, rng.randrange(1, 90)) + [rng.choice([str, half])(rng.choice(items))] + texts(rng, 1, 30)) for _ in range(80)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    index = decontam.Index.build(list(range(20)), items)
    words = Words(pa.array(docs), letters=PLAIN)
    want = set()
    for d in range(len(docs)):
        own = docs[d].replace(".", " ").lower().split()
        for start in range(0, len(own), index.stride):
            held = own[start : start + 2 * index.stride]
            grams = {tuple(held[i : i + 5]) for i in range(len(held) - 4)}
            present = set(np.flatnonzero(np.isin(index.terms, words.hashes[words.first[d] :][start : start + len(held)])).tolist())
            for i, item in enumerate(items):
                w = item.replace(".", " ").lower().split()
                mine = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
                place = index.ids.tolist().index(i)
                score = sum(index.item_impact[r] for k in present for r in range(index.item_first[k], index.item_first[k + 1]) if index.item_of[r] == place)
                if score >= 0.5 - 1e-9 and len(mine & grams) >= 0.8 * len(mine):
                    want.add((d, i))
    assert got == want and 10 < len(want) < 80
