"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Document frequencies, the number of items and their mean length are counted over
all items; they are then dealt to indexes of bounded size, by length and hash,
which tasks build, write to the shared folder and read from there. So scores
don't depend on how many indexes there are. An index is inverted: for each term,
the blocks of items that hold it with the block's largest impact, and below that
the items with their own. Impacts are divided by an item's score for its own
text, so one threshold fits all. Passages are queried many at a time in numpy,
by the two bounds of block-max WAND: a passage whose terms' largest impacts add
up to less than the threshold has no result; a block whose largest impacts add
up to less holds none; only in other blocks are items scored. There is no
document-at-a-time skipping: numpy adds up all postings of a slice of passages
at once. All items at or above the threshold come back.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.words import PLAIN, Words, shingles, text_runs
from webloom.runtime import materialize, scratch_path

#: Items in one index, about. A larger benchmark makes several, which are queried one after another.
MAX_ITEMS = 3000
#: Passages times blocks that are bounded at a time.
CELLS = 4_000_000
#: Items in a block, and words of a shingle.
BLOCK, SHINGLE = 4, 5
K1, B = 1.2, 0.75


def split_item(text: str) -> tuple[str, str]:
    """A test item's question and answer: the last sentence is the answer, if there are several."""
    sentences = re.split(r"(?<=[.!?])\s+", text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def _hashes(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), letters=PLAIN)
    return [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of terms, the rows first[t] to first[t + 1]: which of terms, and the row."""
    counts = first[terms + 1] - first[terms]
    which = np.repeat(np.arange(len(terms)), counts)
    return which, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first[terms], counts)


@dataclass
class Stats:
    """Of all items: how many, their mean length, and sorted terms with the numbers of items that hold them."""

    items: int
    length: float
    terms: np.ndarray
    df: np.ndarray


@dataclass
class Index:
    """Postings in term order, by block and by item; items in the order of their blocks."""

    ids: np.ndarray
    terms: np.ndarray
    most: np.ndarray
    block_first: np.ndarray
    block_of: np.ndarray
    block_impact: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    item_impact: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    stride: int

    @classmethod
    def build(cls, ids: list[int], texts: list[str], stats: Stats | None = None, stride: int | None = None) -> Index | None:
        """None if no item has SHINGLE words or more. Without stats of a larger set, those of the texts are taken, and the longest item for stride."""
        parts = [split_item(t) for t in texts]
        full, question, answer = (_hashes(x) for x in (texts, [p[0] for p in parts], [p[1] for p in parts]))
        usable = [i for i, h in enumerate(full) if len(h) >= SHINGLE]
        if not usable:
            return None
        # a question too short to tell is judged with its answer
        whole = [len(question[i]) < SHINGLE for i in usable]
        questions = [full[i] if w else question[i] for i, w in zip(usable, whole, strict=True)]
        answers = [np.zeros(0, np.uint64) if w else np.unique(answer[i]) for i, w in zip(usable, whole, strict=True)]
        full = [full[i] for i in usable]
        lengths = np.array([len(h) for h in full])
        n = len(full)
        item = np.repeat(np.arange(n), lengths)
        term, of = np.unique(np.concatenate(full), return_inverse=True)
        pair, tf = np.unique(of.astype(np.int64) * n + item, return_counts=True)
        of, item = pair // n, pair % n
        df = np.bincount(of)
        every = stats or Stats(n, float(lengths.mean()), term, df)
        held = every.df[np.searchsorted(every.terms, term)]
        weight = np.log(1 + (every.items - held + 0.5) / (held + 0.5))
        impact = weight[of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / every.length))
        impact /= np.bincount(item, impact, n)[item]
        # items that share their commonest terms go to the same blocks, which keeps the blocks' bounds low
        common = np.zeros((n, 12), dtype=bool)
        for j, t in enumerate(np.argsort(-df, kind="stable")[:12]):
            common[item[of == t], j] = True
        order = np.lexsort(tuple(common.T[::-1]))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        by = np.lexsort((place[item], of))
        of, item, impact = of[by], place[item][by], impact[by]
        blocks = -(-n // BLOCK)
        key, at = np.unique(of * blocks + item // BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, at, impact)
        most = np.zeros(len(term))
        np.maximum.at(most, of, impact)
        each = np.arange(len(term) + 1)
        return cls(
            np.array([ids[usable[i]] for i in order]), term, most, np.searchsorted(key // blocks, each), key % blocks, top,
            np.searchsorted(of, each), item, impact, [np.unique(shingles(questions[i], SHINGLE)) for i in order], [answers[i] for i in order],
            stride or max(64, int(lengths.max())),
        )

    def retrieve(self, words: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All (text, passage, item, score) at or above the threshold.

        Passage j of a text is its words from j * stride, twice the stride long, so
        that any run of as many words as the longest item is within one passage.
        """
        at = np.searchsorted(self.terms, words.hashes)
        at[at == len(self.terms)] = 0
        where = np.flatnonzero(self.terms[at] == words.hashes)
        text = np.searchsorted(words.first, where, "right") - 1
        step = (where - words.first[text]) // self.stride
        counts = -(-words.counts() // self.stride)
        base = np.concatenate([[0], np.cumsum(counts)])
        passage = base[text] + step
        passage = np.concatenate([passage, passage[step > 0] - 1])
        term = np.concatenate([at[where], at[where][step > 0]])
        pairs = np.unique(passage * len(self.terms) + term)
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        # scores are rounded sums: nothing at the threshold may be lost
        low = threshold - 1e-9
        pivot = np.bincount(passage, self.most[term], base[-1]) >= low
        passage, term = passage[pivot[passage]], term[pivot[passage]]
        blocks, parts = -(-len(self.ids) // BLOCK), []
        # passages are in order: slices of them bound the memory, however long a text is
        step = max(1, CELLS // blocks)
        for a in range(0, int(base[-1]), step):
            rows = slice(*np.searchsorted(passage, [a, a + step]))
            if rows.start < rows.stop:
                parts.append(self._scores(passage[rows], term[rows], a, min(step, int(base[-1]) - a), blocks, low))
        passage, item, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        text = np.searchsorted(base, passage, "right") - 1
        return text, passage - base[text], item, score

    def _scores(self, passage: np.ndarray, term: np.ndarray, start: int, count: int, blocks: int, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of what reaches low among `count` passages from start on, by their terms."""
        passage = passage - start
        which, row = _expand(self.block_first, term)
        bound = np.bincount(passage[which] * blocks + self.block_of[row], self.block_impact[row], count * blocks) >= low
        alive = bound.reshape(-1, blocks).any(axis=1)
        passage, term = passage[alive[passage]], term[alive[passage]]
        which, row = _expand(self.item_first, term)
        open_ = bound[passage[which] * blocks + self.item_of[row] // BLOCK]
        key = passage[which[open_]] * len(self.ids) + self.item_of[row[open_]]
        found, of = np.unique(key, return_inverse=True)
        score = np.bincount(of, self.item_impact[row[open_]], len(found))
        found, score = found[score >= low], score[score >= low]
        return found // len(self.ids) + start, found % len(self.ids), score

    def overlaps(self, words: Words, text: int, passage: int, item: int) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that the passage holds."""
        start = words.first[text] + passage * self.stride
        held = words.hashes[start : min(start + 2 * self.stride, words.first[text + 1])]
        question = float(np.isin(self.questions[item], shingles(held, SHINGLE)).mean())
        answer = float(np.isin(self.answers[item], held).mean()) if len(self.answers[item]) else 1.0
        return question, answer


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, terms) added to (item_id, item, chunk): the number of words and the distinct ones."""
    for batch in batches:
        hashes = _hashes(batch.column(1).to_pylist())
        terms = pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(h) for h in hashes], pa.int64()), terms], names=["item_id", "item", "length", "terms"])


def build_indexes(items: DataFrame) -> list[str]:
    """Write indexes of all items (item_id, item) of SHINGLE words or more into the shared folder; their paths.

    The paths are one for MAX_ITEMS items and length class (powers of two from
    64 words on), since passages are twice as long as the class allows its items to be.
    """
    spark = items.sparkSession
    small_batches(spark)
    read = materialize(items.mapInArrow(_read_items, "item_id long, item string, length long, terms array<long>").filter(F.col("length") >= SHINGLE), "items")
    about = read.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length")).first()
    if not about["n"]:
        return []
    chunks = -(-about["n"] // MAX_ITEMS)
    class_ = F.greatest(F.lit(6), F.ceil(F.log2(F.col("length").cast("double"))).cast("int"))
    dealt = read.withColumn("chunk", class_ * chunks + F.pmod(F.xxhash64("item_id", "item"), F.lit(chunks)).cast("int"))
    terms = dealt.select("chunk", F.explode("terms").alias("term"))
    df = terms.groupBy(F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("df"))
    own = terms.distinct().join(df, F.col("term") == F.col("_term")).select(F.col("chunk").alias("part"), "term", "df")
    folder = scratch_path(spark, "bm25")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("term").to_numpy().view(np.uint64)
        order = np.argsort(known)
        left = left.sort_by([("item_id", "ascending"), ("item", "ascending")])
        stats = Stats(about["n"], about["length"], known[order], right.column("df").to_numpy()[order])
        # passages are as long as the length class says, whichever of its items are in this index
        stride = 2 ** (left.column("chunk")[0].as_py() // chunks)
        index = Index.build(left.column("item_id").to_pylist(), left.column("item").to_pylist(), stats, stride)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(pickle.dumps(index))
        return pa.table({"path": [f"{folder}/{name}"]})

    made = dealt.select("chunk", "item_id", "item").groupBy("chunk").cogroup(own.groupBy("part")).applyInArrow(build, "path string")
    return sorted(r["path"] for r in materialize(made, "indexes").collect())


@lru_cache(maxsize=8)
def _index(path: str) -> Index:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as file:
        return pickle.loads(file.read())


def _leaks(texts: pa.Array, paths: list[str], threshold: float, overlap: float) -> Iterator[dict[tuple[int, int], tuple]]:
    """By runs of texts: of each (text, item id), the largest overlaps and their score."""
    for first, run in text_runs(texts):
        words = Words(run, letters=PLAIN)
        best: dict[tuple[int, int], tuple] = {}
        for path in paths:
            index = _index(path)
            for text, passage, item, score in zip(*index.retrieve(words, threshold), strict=True):
                question, answer = index.overlaps(words, text, passage, item)
                if question >= overlap and answer >= overlap:
                    # repeated items with one id are one
                    key, value = (first + int(text), int(index.ids[item])), (question, answer, float(score))
                    best[key] = max(best.get(key, value), value)
        yield best


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): test items that documents hold.

    Every passage of every document is a query. An item is retrieved if its BM25
    score is at least threshold times the score of its own text, and it leaks if
    the passage holds at least the share `overlap` of its question's five-word
    shingles and of its answer's words. A document and an item make one row, of
    the passage with the largest overlaps. Words are runs of letters and digits
    with A-Z lower-cased; other scripts count as letters, so that items without
    spaces have few words. Items of fewer than five words, and null ones, are too
    short to tell and never match; nor do null and empty texts. Repeated rows of
    docs give repeated rows, rows with a null id rows without one; repeated items
    count once, those with a null id are left out. Empty tables give an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    paths = build_indexes(_items(items, item_col, item_text))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for best in _leaks(batch.column(1), paths, threshold, overlap):
                if best:
                    ids = batch.column(0).take(pa.array([t for t, _ in best], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([i for _, i in best], pa.int64()), *(pa.array([v[k] for v in best.values()]) for k in (2, 0, 1))],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def _items(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item")).filter("item is not null and item_id is not null").distinct()


def drop_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of docs whose text holds no test item, in all their columns.

    Rows are judged by their own text while they are read, so ids don't matter
    and nothing is shuffled. See find_leaks() for what leaks.
    """
    paths = build_indexes(_items(items, item_col, item_text))

    def clean(texts: pa.Array) -> pa.Array:
        kept = np.ones(len(texts), dtype=bool)
        for best in _leaks(texts, paths, threshold, overlap):
            kept[[t for t, _ in best]] = False
        return pa.array(kept)

    small_batches(docs.sparkSession)
    return docs.filter(F.arrow_udf(clean, "boolean")(F.col(text_col)))
