import collections
import re

import corpus_pipeline
from webloom.llm import mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(text.lower())
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = corpus_pipeline.stage_quality(spark, docs, SF).cache()
    good = {r["doc_id"] for r in one.collect()}
    wrong = [i for i, q in labels.items() if (i in good) != bool(q)]
    assert one.columns == columns and len(wrong) <= 0.05 * len(labels)

    two = corpus_pipeline.stage_near_duplicates(spark, one, SF).cache()
    rows = sorted((r["doc_id"], shingles(r["text"], 5)) for r in one.collect())
    root = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root[i], root[j]
                for n in root:
                    if root[n] == max(x, y):
                        root[n] = min(x, y)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(root.values())) and two.columns == columns

    three = corpus_pipeline.stage_decontaminate(spark, two, SF).cache()
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(i in " ".join(re.findall(r"\w+", t.lower())) for i in items)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(r["doc_id"] for r in two.collect() if not holds(r["text"])) and three.columns == columns

    four = corpus_pipeline.stage_mix(spark, three, SF).cache()
    assert four.columns == columns
    times = collections.Counter(r["doc_id"] for r in four.collect())
    assert times == {r["doc_id"]: r["copies"] for r in mixing.mix_sources(three).collect() if r["copies"]}

    five = corpus_pipeline.stage_shard(spark, four, SF).collect()
    assert collections.Counter(r["doc_id"] for r in five) == times
    slots = collections.defaultdict(list)
    for r in five:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_without_ids_and_repeats(spark):
    rows = [(None, "good words here and there " * 9, "en", "s", 1), (None, None, None, None, None), (5, "a b c d e f g", "en", "s", 1), (5, "a b c d e f g", "en", "s", 1), (6, "a b c d e f g", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.stage_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [5, None, None]
    # null ids follow the rule of all ids: the stage takes the copies that the operator says
    said = collections.Counter({None: 0})
    for r in mixing.mix_sources(docs).collect():
        said[r["doc_id"]] += r["copies"]
    assert +said == collections.Counter(r["doc_id"] for r in corpus_pipeline.stage_mix(spark, docs, SF).collect()) and said[None] >= 2
    assert corpus_pipeline.stage_shard(spark, docs, SF).count() == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_unlike_texts_of_one_id_both_stay(spark):
    texts = [f"{w} " * 3 + " ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(5, texts[0], "s"), (5, texts[1], "s"), (5, texts[1], "s"), (7, texts[1] + " more", "s"), (8, texts[2], "s"), (None, texts[2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as number", "2 as row", "3 as _kept", "4 as size", "5 as shard", "6 as _row", "7 as same")
    kept = corpus_pipeline.stage_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(5, texts[0]), (5, texts[1]), (8, texts[2])]
    for name, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, docs, SF)
        assert name == "shard" or out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {5, 7, 8, None}
