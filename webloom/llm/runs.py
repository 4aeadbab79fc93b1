"""Runs of repeated words in documents, by the linear method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are equal)
that cannot grow. For a batch of documents at a time, in numpy:

1. Words get numbers, and stretches of 1, 2, 4, ... words get ranks (prefix
   doubling). The ranks give the suffix array, any common extension of two
   places to the right or the left, and with the longest common prefixes of
   neighbours the nodes of the suffix tree (intervals of the suffix array).
2. The Lempel-Ziv blocks of each document: each is the longest stretch that
   also begins further left. Squares that begin or end at a block's edge, found
   by common extensions around it, cover the leftmost square of every kind.
3. From each of them suffix links are followed: the square's first word leaves,
   and if the tree goes on with that same word, the square of the words one to
   the right is of the vocabulary too. A walk follows one place of the text as
   far as that repeats, then turns to another place below the same node, and
   stops at squares that are marked. The vocabulary is the set of these nodes.
4. The suffixes below a node are all places of its square. Places next to each
   other merge into runs.

Only squares of primitive words are kept, so a run is found with its smallest
period, and the squares of a document of n words are O(n log n).

A run of at least m words and at least e periods has a stretch of m - m / e
words that occurs a period later as well. Documents without such a repeated
stretch (by the ranks of step 1) hold no run and end there.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.cuts import cut, ranges, spaced, strings
from webloom.llm.words import text_runs

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _double(rank: np.ndarray, active: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of stretches twice as long, and the places whose stretch is not the only one of its kind.

    A rank is one more than the number of smaller suffixes' stretches; past a
    document's end it is 0.
    """
    n = len(rank) - 1
    after = active + width
    second = np.where(after < ends[active], rank[np.minimum(after, n)], 0)
    key = rank[active].astype(np.int64) * (n + 2) + second
    order = np.argsort(key, kind="stable")
    key, place = key[order], active[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    before = rank[place]
    old = np.ones(len(key), dtype=bool)
    old[1:] = before[1:] != before[:-1]
    at = np.arange(len(key))
    group = np.maximum.accumulate(np.where(new, at, 0))
    ranked = rank.copy()
    ranked[place] = before + (group - np.maximum.accumulate(np.where(old, at, 0)))
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ranked, place[~alone]


def _first_ranks(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of single words (those of two documents differ), the places of words that repeat, each place's end of document."""
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    start = np.append(np.repeat(first[:-1] + 1, counts), 0).astype(np.int32)
    # ranks of whole documents, made finer by their words
    key = start[:-1].astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(len(words) + 1, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) + 1
    alone = new.copy()
    alone[:-1] &= new[1:]
    return rank, order[~alone], ends


def repeating(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The documents in which a stretch of width words, or of somewhat fewer, begins at two places."""
    rank, active, ends = _first_ranks(words, first)
    w = 1
    while 2 * w <= width and len(active):
        rank, active = _double(rank, active, ends, w)
        w *= 2
    return np.unique(np.searchsorted(first, active, "right") - 1)


class _Minima:
    """Smallest values over any stretch of an array, by powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, step = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far to go left from at (exclusive) so that all values passed are >= least: the place of the last one passed."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            to = at - 2**j
            at = np.where((to >= 0) & (self.levels[j][np.maximum(to, 0)] >= least), to, at)
        return at

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from at on whose value is under least (or the array's end)."""
        at, n = at.copy(), len(self.levels[0])
        for j in range(len(self.levels) - 1, -1, -1):
            fits = at + 2**j <= n
            at = np.where(fits & (self.levels[j][np.where(fits, at, 0)] >= least), at + 2**j, at)
        return at


class SuffixTree:
    """Suffix array, longest common prefixes and common extensions of the words of some documents."""

    def __init__(self, words: np.ndarray, first: np.ndarray) -> None:
        self.first = first
        self.n = len(words)
        rank, active, ends = _first_ranks(words, first)
        self.ends = ends
        self.levels = [rank]
        while len(active):
            rank, active = _double(rank, active, ends, 2 ** (len(self.levels) - 1))
            self.levels.append(rank)
        self.rank = rank[:-1] - 1
        self.suffixes = np.empty(self.n, dtype=np.int64)
        self.suffixes[self.rank] = np.arange(self.n)
        common = np.zeros(self.n, dtype=np.int64)
        common[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])
        self.common = _Minima(common)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i and j differ)."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        begun = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            step = (rank[i] == rank[j]) << np.int64(level)
            i += step
            j += step
        return i - begun

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i, itself included, equal those up to j (i is less than j)."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        begun = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[level], 1 << level
            a, b = i - width + 1, j - width + 1
            step = ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])) << np.int64(level)
            i -= step
            j -= step
        return begun - i

    def node(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the length words at place."""
        r = self.rank[place]
        return self.common.left(r + 1, length) - 1, self.common.right(r + 1, length)

    def child(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The first suffix of the interval that goes on with the word (a rank of one word) after length words; -1 if none."""
        words = self.levels[0]
        a, b = low.copy(), high.copy()
        while (a < b).any():
            middle = np.minimum((a + b) // 2, self.n - 1)
            less = (words[self._after(self.suffixes[middle], length)] < word) & (a < b)
            a, b = np.where(less, middle + 1, a), np.where(less | (a >= b), b, middle)
        at = np.minimum(a, self.n - 1)
        return np.where((a < high) & (words[self._after(self.suffixes[at], length)] == word), at, -1)

    def _after(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place length words later; the empty one behind all documents if that is past the document's end."""
        to = place + length
        return np.where(to < self.ends[place], to, self.n)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Where Lempel-Ziv blocks begin, and the end of each one's document."""
        places = _Minima(self.suffixes)
        at = np.arange(self.n)
        left = places.left(at, self.suffixes) - 1
        right = places.right(at + 1, self.suffixes)
        longest = np.zeros(self.n, dtype=np.int64)
        for other in (left, right):
            ok = (other >= 0) & (other < self.n)
            here = self.suffixes[ok]
            longest[here] = np.maximum(longest[here], self.forward(here, self.suffixes[other[ok]]))
        step = np.maximum(longest, 1).tolist()
        found = []
        i = 0
        while i < self.n:  # a document's last block ends with it, as no stretch reaches over two documents
            found.append(i)
            i += step[i]
        begins = np.array(found, dtype=np.int64)
        return begins, self.ends[begins]


def _covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [start, end) of a period around the edges of blocks, which cover every square's leftmost place."""
    h, end = tree.blocks()
    h1 = np.append(h[1:], tree.n)
    h2 = np.minimum(np.append(h1[1:], tree.n), end)
    word = tree.levels[0]
    found = []
    # (anchor, how far away the equal word may be, on which side)
    inner = h1 < end
    for anchor, most, side in ((h1[inner], (h1 - h)[inner], -1), (h, h2 - h, 1)):
        k = ranges(np.ones(len(most), dtype=np.int64), most)
        a = np.repeat(anchor, most)
        q = a + side * k
        ok = q < np.repeat(tree.ends[anchor], most)
        k, a, q = k[ok], a[ok], q[ok]
        ok = word[a] == word[q]
        k, low, high = k[ok], np.minimum(a, q)[ok], np.maximum(a, q)[ok]
        right, left = tree.forward(low, high), tree.backward(low - 1, high - 1)
        ok = right + left >= k
        found.append((low[ok] - left[ok], high[ok] + right[ok], k[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _primitive(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the period words at start are no repetition of fewer words; period more words must equal them."""
    top = int(period.max(initial=1))
    factor = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, top + 1, p)] = p
    sound, rest = np.ones(len(period), dtype=bool), period.copy()
    while (rest > 1).any():
        todo = np.flatnonzero(rest > 1)
        p = factor[rest[todo]]
        d = period[todo] // p
        sound[todo] &= tree.forward(start[todo], start[todo] + d) < 2 * period[todo] - d
        rest[todo] //= p
    return sound


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[new] for c in columns)


def _vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (interval and period) of all squares of primitive words, by suffix-link walks from the covering ones."""
    start, end, k = _distinct(*_covering(tree))
    ok = _primitive(tree, start, k)
    start, end, k = start[ok], end[ok], k[ok]
    marked = np.zeros(0, dtype=np.int64)
    nodes: list[tuple[np.ndarray, ...]] = []
    while len(start):
        counts = end - start - 2 * k + 1
        place, period = ranges(start, counts), np.repeat(k, counts)
        low, high = tree.node(place, 2 * period)
        key = low * (tree.n + 1) + period
        key, at = np.unique(key, return_index=True)
        new = ~np.isin(key, marked)
        nodes.append((low[at[new]], high[at[new]], period[at[new]]))
        marked = np.union1d(marked, key)
        # where a place's repetition ends: does another place below the same node go on with the square's first word?
        last = end - 2 * k
        low, high = tree.node(last, 2 * k)
        below = tree.child(low, high, 2 * k, tree.levels[0][last])
        ok = below >= 0
        place, k = tree.suffixes[below[ok]], k[ok]
        low, _ = tree.node(place + 1, 2 * k)
        ok = ~np.isin(low * (tree.n + 1) + k, marked)
        place, k = place[ok], k[ok]
        start, end = place - tree.backward(place - 1, place + k - 1), place + k + tree.forward(place, place + k)
        start, end, k = _distinct(start, end, k)
    return tuple(np.concatenate(x) for x in zip(*nodes, strict=True)) if nodes else (np.zeros(0, np.int64),) * 3


def _located(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of two periods or more: start, length and period."""
    low, high, k = _vocabulary(tree)
    place, period = tree.suffixes[ranges(low, high - low)], np.repeat(k, high - low)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin, len(place))[1:] - 1
    return place[begin], place[last] - place[begin] + 2 * period[begin], period[begin]


def find_runs(words: np.ndarray, first: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> tuple[np.ndarray, ...]:
    """Runs in documents of word numbers: document, start in it, length and period, by document, start and period.

    Document i has words[first[i]:first[i + 1]]. A run has at least min_length
    words and min_exponent periods (2 or more).
    """
    none = (np.zeros(0, dtype=np.int64),) * 4
    needed = max(1, -(-min_length * (min_exponent - 1) // min_exponent))
    docs = repeating(words, first, needed) if len(words) else ()
    if not len(docs):
        return none
    counts = np.diff(first)[docs]
    inner = np.concatenate([[0], np.cumsum(counts)])
    start, length, period = _located(SuffixTree(words[ranges(first[docs], counts)], inner))
    ok = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    doc = np.searchsorted(inner, start, "right") - 1
    doc, start = docs[doc], start - inner[doc]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def _run_arrays(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and its words without repetitions, joined by single spaces."""
    found = cut(texts)
    words = found.words.dictionary_encode()
    numbers = words.indices.to_numpy().astype(np.int64)
    doc, start, length, period = find_runs(numbers, found.first, min_length, min_exponent)
    each = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(each, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
    change = np.zeros(len(numbers) + 1, dtype=np.int64)
    begin = found.first[doc] + start
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    data, begins = spaced(found.words)
    bytes_kept = np.repeat(kept, np.diff(begins))
    # no space behind a text's last word that stays
    upto = np.concatenate([[0], np.cumsum(kept)])[found.first]
    last = np.flatnonzero(kept)[upto[1:][np.diff(upto) > 0] - 1]
    bytes_kept[begins[last + 1] - 1] = False
    places = np.concatenate([[0], np.cumsum(bytes_kept)])[begins[found.first]]
    return runs, strings(data[bytes_kept], places).cast(pa.string())


def collapse_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, runs (start, length and period in words, by start and period) and collapsed text.

    Words are what stands between spaces and tabs to carriage returns. A word is
    left out of the collapsed text if a run holds it after the run's first
    period; the rest are joined by single spaces. A null or empty text has no
    runs and an empty collapsed text. Null and repeated ids give a row each; other
    columns are not read. Runs need at least min_exponent periods, which must be
    2 or more, and at least min_length words.
    """
    if Fraction(min_exponent) < 2 or int(min_exponent) != min_exponent:
        raise ValueError("min_exponent must be a whole number from 2 on")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_runs(batch.column(1)):
                runs, collapsed = _run_arrays(texts, int(min_length), int(min_exponent))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), runs, collapsed], ["id", "runs", "collapsed"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, runs {RUNS}, collapsed string"
    found = rows.mapInArrow(judge, schema)
    return found.withColumnRenamed("id", id_col)
