"""Phrases whose words stand together more often than their parts would let expect.

Two passes over the texts. In the first, tasks count hashes of all phrases (and
single words) in count-min sketches; the sketches are added up slice by slice,
so a counter is at least the number of times that each of its phrases occurs. In
the second, a phrase all of whose counters reach the minimum is a survivor, and
survivors are counted by their words, exactly: tasks add up their own first, and
one shuffle adds up the tasks. A phrase that occurs often enough always
survives, so nothing frequent is lost; a rare one that survives by collisions
falls out by its exact count.

What a task sends of a sketch are its counters above zero, sorted, as gaps: that
grows with the text and not with tasks times width. Of the merged sketch, files
of one bit a counter are kept in the shared folder (whether it reaches the
minimum), which workers map into memory. The width follows the bytes of text up
to MAX_WIDTH, which bounds the files at 2 * MAX_WIDTH / 8 bytes; beyond that,
more rare phrases survive to the exact counts, and the result stays the same.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.cuts import cut, ranges, spaced, strings
from webloom.llm.words import Words, constants, mix, text_runs
from webloom.operators.ordered import range_parts, running_totals
from webloom.runtime import materialize, scratch_path, shuffle_partitions

#: Pieces end at these marks and at line feed to carriage return; words also end at spaces and tabs.
MARKS = b".,;:!?\n\x0b\x0c\r"
_MARK = np.array([b in MARKS for b in range(256)])
_LETTER = np.array([b not in MARKS + b" \t" for b in range(256)])
#: Rows of the sketch, each with a hash of its own.
ROWS = 2
#: Counters in a slice, which is merged as a whole and makes one file.
SLICE = 1 << 21
#: Counters in a row, at most (its file of bits then has 512 MB).
MAX_WIDTH = 1 << 32


@dataclass(frozen=True)
class Shape:
    """Counters in a row of the sketch (a power of two) and in a slice, phrases that a task counts before it sends them on, and survivors before it adds them up."""

    width: int
    slice: int = SLICE
    flush: int = 1_500_000
    combine: int = 150_000

    @property
    def per(self) -> int:
        return min(self.slice, self.width)


def _language(name: str | None, default: str) -> int:
    return int.from_bytes(hashlib.blake2b((default if name is None else name).encode(), digest_size=8).digest(), "little")


def _grams(texts: pa.Array, langs: pa.Array, default: str, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each k up to most: k, where the phrases of k words begin (numbers of words), and their hashes with the language."""
    words = Words(texts, letters=_LETTER)
    marks = np.concatenate([[0], np.cumsum(_MARK[words.data])])
    n = len(words.hashes)
    text = np.repeat(np.arange(len(texts)), words.counts())
    piece = marks[words.starts] + text
    codes = langs.dictionary_encode()
    known = np.array([_language(x, default) for x in [*codes.dictionary.to_pylist(), None]], dtype=np.uint64)
    lang = known[codes.indices.fill_null(len(known) - 1).to_numpy()][text]
    c = constants(most, 23)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(1, most + 1):
        if n < k:
            return
        total = total[: n - k + 1] + words.hashes[k - 1 :] * c[k - 1]
        whole = np.flatnonzero(piece[k - 1 :] == piece[: n - k + 1])
        yield k, whole, mix(total[whole] + lang[whole] + np.uint64(k))


def _places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counters of hashes in a row of the sketch."""
    bits = np.uint64(width.bit_length() - 1)
    return (hashes if row == 0 else mix(hashes + np.uint64(row))) >> (np.uint64(64) - bits)


def _packed(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    raw = gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(2, 4, -1)
    gaps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in raw)
    return np.cumsum(gaps), counts


def _slices(hashes: np.ndarray, shape: Shape) -> pa.RecordBatch:
    """Counters of a sketch of the hashes, by row and slice."""
    rows, numbers, blobs = [], [], []
    width, per = shape.width, shape.per
    for row in range(ROWS):
        places = np.sort(_places(hashes, row, width))
        begin = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, np.int64)
        counts, places = np.diff(np.append(begin, len(places))), places[begin].astype(np.int64)
        cuts = np.searchsorted(places, np.arange(0, width + per, per))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            inside = places[cuts[s] : cuts[s + 1]] - s * per
            rows.append(row)
            numbers.append(s)
            blobs.append(_packed(np.diff(inside, prepend=0), counts[cuts[s] : cuts[s + 1]]))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["row", "slice", "blob"])


def _write_bits(folder: str, counters: np.ndarray, least: int) -> str:
    """Write which counters of a slice reach the minimum, under a name of its own; the file's path."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(np.packbits(counters >= least, bitorder="little").tobytes())
    return f"{folder}/{name}"


def sketch(docs: DataFrame, min_count: int, max_words: int, shape: Shape, default: str) -> dict[tuple[int, int], str]:
    """Count all phrases of the columns text and lang in a merged sketch; the files of its bits by row and slice.

    There are at most ROWS * MAX_WIDTH / SLICE files; a slice without one has no counter that is not zero.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "sketch")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at, texts in text_runs(batch.column(0)):
                for _, _, hashes in _grams(texts, batch.column(1).slice(at, len(texts)), default, max_words):
                    held.append(hashes)
                    n += len(hashes)
                if n >= shape.flush:
                    yield _slices(np.concatenate(held), shape)
                    held, n = [], 0
        if n:
            yield _slices(np.concatenate(held), shape)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(0, dtype=np.int64)
        done = []
        for batch in batches:
            for row, number, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, number) != now:
                    if now:
                        done.append((*now, _write_bits(folder, counters, min_count)))
                    now, counters = (row, number), np.zeros(shape.per, dtype=np.int64)
                places, counts = _unpacked(blob)
                counters[places] += counts
        if now:
            done.append((*now, _write_bits(folder, counters, min_count)))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["row", "slice", "path"])

    parts = docs.select("text", "lang").mapInArrow(count, "row int, slice int, blob binary")
    parts = parts.repartition(shuffle_partitions(spark), "row", "slice").sortWithinPartitions("row", "slice")
    found = materialize(parts.mapInArrow(merge, "row int, slice int, path string"), "sketch-slices")
    return {(r["row"], r["slice"]): r["path"] for r in found.collect()}


@lru_cache(maxsize=8192)
def _bits(path: str) -> np.ndarray:
    """A slice's bits: mapped where the shared folder is a mounted one, else read."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, dtype=np.uint8, mode="r")
    with system.open_input_stream(place, compression=None) as file:
        return np.frombuffer(file.read(), dtype=np.uint8)


def _survive(files: dict[tuple[int, int], str], hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether all counters of each hash reach the minimum."""
    alive = np.arange(len(hashes))
    width, per = shape.width, shape.per
    for row in range(ROWS):
        places = _places(hashes[alive], row, width).astype(np.int64)
        order = np.argsort(places, kind="stable")
        places = places[order]
        cuts = np.searchsorted(places, np.arange(0, width + per, per))
        full = np.zeros(len(places), dtype=bool)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            inside = places[cuts[s] : cuts[s + 1]] - s * per
            full[cuts[s] : cuts[s + 1]] = (_bits(files[row, s])[inside >> 3] >> (inside & 7).astype(np.uint8)) & 1
        alive = alive[order[full]]
    keep = np.zeros(len(hashes), dtype=bool)
    keep[alive] = True
    return keep


_COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _added_up(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return total.rename_columns(["lang", "words", "phrase", "f"]).cast(_COUNTED)


def _survivors(texts: pa.Array, langs: pa.Array, default: str, most: int, files: dict[tuple[int, int], str], shape: Shape) -> pa.Table:
    """Counts of the surviving phrases of some texts by their words, and of all words (words 0, no phrase)."""
    found = cut(texts, _LETTER, lower=True)
    # consecutive words are one stretch of these bytes
    data, begins = spaced(found.words)
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    lang = langs.fill_null(default)
    per_text = pa.table([lang, pa.array([0] * len(texts), pa.int32()), pa.nulls(len(texts), pa.string()), pa.array(np.diff(found.first))], schema=_COUNTED)
    tables = [per_text]
    for k, at, hashes in _grams(texts, langs, default, most):
        at = at[_survive(files, hashes, shape)]
        sizes = begins[at + k] - 1 - begins[at]
        phrases = strings(data[ranges(begins[at], sizes)], np.concatenate([[0], np.cumsum(sizes)])).cast(pa.string())
        tables.append(pa.table([lang.take(pa.array(text[at])), pa.array(np.full(len(at), k, dtype=np.int32)), phrases, pa.array(np.ones(len(at), dtype=np.int64))], schema=_COUNTED))
    return _added_up(tables)


def phrase_counts(docs: DataFrame, min_count: int = 10, max_words: int = 3, default: str = "und", shape: Shape | None = None) -> DataFrame:
    """Exact counts f of all phrases of 1 to max_words words that occur min_count times or more, per lang.

    Columns lang, words, phrase (joined by single spaces) and f; a row with words
    0 and no phrase has the number of all words of a lang. docs has columns text
    and lang; nulls are an empty text and the language default. Without a shape,
    the sketch's width follows from the bytes of text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if shape is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shape = Shape(min(MAX_WIDTH, max(1 << 16, 1 << (size // 8).bit_length())))
    files = sketch(docs, min_count, max_words, shape, default)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at, texts in text_runs(batch.column(0)):
                held.append(_survivors(texts, batch.column(1).slice(at, len(texts)), default, max_words, files, shape))
                n += len(held[-1])
                if n >= shape.combine:
                    held = [_added_up(held)]
                    n = len(held[0])
                    if n >= shape.combine:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if held:
            yield from _added_up(held).to_batches(max_chunksize=50_000)

    some = docs.select("text", "lang").mapInArrow(count, "lang string, words int, phrase string, f long")
    return some.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("words") == 0))


def _joined(words: F.Column, begin: F.Column | int, length: F.Column | int) -> F.Column:
    return F.array_join(F.slice(words, begin, length), " ")


def score_expr() -> F.Column:
    """floor(10**6 * a * a / (l * r)) of the columns a, l and r, exact for counts up to 10**15."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"cast(1000000 as decimal(7, 0)) * ({whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")


def _with_part_counts(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """parts with the count of (lang, part) as part_f.

    A part in more than a five-thousandth of all phrases of its length is
    broadcast (there are at most 5,000 of them a length), so the key of the join
    that is shuffled has a bounded share of the rows.
    """
    totals = counts.filter("words > 0").groupBy("words").agg((F.sum("f") / 5000).alias("least")).withColumnRenamed("words", "_words")
    heavy = counts.join(F.broadcast(totals), counts["words"] == totals["_words"]).filter(F.col("f") >= F.col("least"))
    side = lambda df: df.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("part_f"))
    heavy = side(materialize(heavy.select("lang", "phrase", "f"), "heavy-parts"))
    on = lambda a, b: (a["lang"] == b["_lang"]) & (a["part"] == b["_phrase"])
    near = parts.join(F.broadcast(heavy), on(parts, heavy)).drop("_lang", "_phrase")
    rest = parts.join(F.broadcast(heavy), on(parts, heavy), "left_anti")
    all_counts = side(counts.filter("words > 0"))
    return near.unionByName(rest.join(all_counts, on(rest, all_counts)).drop("_lang", "_phrase"))


def collocations(
    docs: DataFrame,
    min_count: int = 10,
    max_words: int = 3,
    subsumed_percent: int = 50,
    top: int | None = 2000,
    default: str = "und",
    text_col: str = "text",
    lang_col: str = "lang",
    shape: Shape | None = None,
) -> DataFrame:
    """Phrases of 2 to max_words words that occur min_count times or more, scored and subsumed, per language.

    The score is floor(10**6 * a * a / (l * r)) of the cut after k words whose
    score is lowest (ties: smallest k), a being the phrase's count, l and r those
    of the parts. A phrase is dropped if a longer candidate holds its words and
    has subsumed_percent or more of its count. Ranks go by score and count,
    descending, then by phrase in byte order; top None ranks all. The result has
    lang, rank, phrase, a, l, r, n (all words of the lang) and score. Null texts
    are empty and null languages are default; repeated rows count each; an empty
    table gives an empty result. Counts may reach 10**15.
    """
    small = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialize(phrase_counts(small, min_count, max_words, default, shape), "phrase-counts")
    words = F.split("phrase", " ")
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    pair = F.array(
        F.struct(F.lit(True).alias("left"), _joined(words, F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _joined(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )
    parts = cuts.withColumn("_p", F.explode(pair)).select("lang", "phrase", "words", "a", "k", "_p.left", "_p.part")
    counted = _with_part_counts(parts, counts)
    both = counted.groupBy("lang", "phrase", "words", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r")
    )
    scored = both.withColumn("score", score_expr()).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # phrases inside longer candidates, with the largest count of these
    inner = candidates.filter("words > 2").withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1)))
    inner = inner.groupBy(F.col("lang").alias("_lang"), _joined(words, F.col("_at"), F.col("_n")).alias("_phrase")).agg(F.max("a").alias("_longer"))
    free = scored.join(inner, (scored["lang"] == inner["_lang"]) & (scored["phrase"] == inner["_phrase"]), "left")
    free = free.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < subsumed_percent * F.col("a")))
    free = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # a language may hold most of the rows: each of 64 parts of it gives its first ones
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        free = free.withColumn("_place", F.row_number().over(salted)).filter(F.col("_place") <= top).drop("_place")
        ranked = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    else:
        order = [F.col("lang"), *order]
        ranked = running_totals(range_parts(free, order, "phrases"), order, {"rank": F.lit(1).cast("long")}, ["lang"]).drop("_part")
    n = counts.filter("words = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    ranked = ranked.join(n, ranked["lang"] == n["_lang"])
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
