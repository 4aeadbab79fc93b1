import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webloom.llm import ngram


def brute(train, order):
    grams = {order: Counter()}
    for t in train:
        w = ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
        for i in range(order - 1, len(w)):
            grams[order][tuple(w[i - order + 1 : i + 1])] += 1
    plain = Counter()
    for g, c in grams[order].items():
        plain[g[-1]] += c
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut = {k: ngram.discounts(*(sum(c == n for c in g.values()) for n in (1, 2, 3, 4))) for k, g in grams.items()}
    by = {k: defaultdict(list) for k in grams}
    for k, g in grams.items():
        for x, c in g.items():
            by[k][x[:-1]].append(c)

    def p(gram):
        k = len(gram)
        below = p(gram[1:]) if k > 1 else 1 / (len(plain) + 1)
        counts = by[k].get(gram[:-1])
        if not counts:
            return below
        d = lambda c: cut[k][min(c, 3) - 1] if c else 0
        c = grams[k].get(gram, 0)
        return max(c - d(c), 0) / sum(counts) + sum(d(x) for x in counts) / sum(counts) * below

    return plain, p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(ngram, "BUCKET_TOKENS", 300)
    rng = random.Random(order)
    vocabulary = [f"W{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randrange(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "unseen words"), (3, rows[3][1]), (204, "w1 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram.language_model_scores(docs, order).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain, p = brute([t or "" for i, t in rows if not held(i)], order)
    n, v = sum(plain.values()), len(plain)
    for i, t in rows:
        w = (t or "").lower().split() + ["</s>"]
        r = got[i, len(w)]
        assert r["held_out"] == held(i) and r["train_tokens"] == n and r["n_known"] == sum(plain[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((plain[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        x = ["<s>"] * (order - 1) + w
        assert math.isclose(r["score"], sum(math.log10(p(tuple(x[k - order + 1 : k + 1]))) for k in range(order - 1, len(x))), rel_tol=1e-9)
    # a distribution over the vocabulary and one unknown word
    assert math.isclose(sum(p(("<s>",) * (order - 1) + (x,)) for x in [*plain, "?"]), 1, rel_tol=1e-9)


def test_empty(spark):
    assert ngram.language_model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_tell_words_by_two_words_before(spark):
    rows = [(i, t) for i, t in enumerate(["a x b", "c x d"] * 30)]
    frame = spark.createDataFrame([*rows, (1000, "a x b"), (1001, "a x d")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram.language_model_scores(frame).collect()}
    assert got[1000] > got[1001] + 0.5


def test_common_contexts_null_ids_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BUCKET_TOKENS", 200)
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(ngram, "COMMONEST", 5)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 41), k=rng.randrange(80))), 1, 2) for i in range(150)] + [(None, "w1 w2 w3", 1, 2), (None, "w1 w2 w3", 1, 2), (500, "w1 " * 60_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out int, level int").repartition(4)
    got = ngram.language_model_scores(docs, 3)
    plain, p = brute([t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in got.filter("doc_id < 40 or doc_id is null").collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        x = ["<s>"] * 2 + text.lower().split() + ["</s>"]
        assert math.isclose(r["score"], sum(math.log10(p(tuple(x[k - 2 : k + 1]))) for k in range(2, len(x))), rel_tol=1e-9)
        assert r["doc_id"] is not None or not r["held_out"]
    assert got.count() == len(rows)


def test_short_contexts_differ_within_a_bucket():
    """A bucket's contexts share their hashes' first bits; what is kept of them does not."""
    hashes = (np.uint64(0xABC) << np.uint64(52)) | (np.random.default_rng(1).integers(0, 1 << 52, 50_000, dtype=np.uint64))
    assert len(np.unique(ngram._bucket(hashes, 4096))) == 1
    kept = ngram._short(hashes)
    top = np.bincount((kept >> np.uint64(56)).astype(np.int64), minlength=256)
    assert top.min() > 100 and len(np.unique(kept)) == 50_000 and not (kept & ngram.TAIL_MASK).any()


def test_a_block_fits_a_worker():
    """A worker that counts three-word phrases takes some 170 bytes a token of its block beside the interpreter: no more than 400 MB."""
    assert ngram.BLOCK_TOKENS * 180 <= 400 << 20
