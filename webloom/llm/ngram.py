"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped into memory by workers.

Words are counted first: the reducer of a range of word hashes writes them as a
sorted array, and a word's number is its place there. Blocks of tokens are then
counted map-side and their distinct n-grams dealt out by the hash of their
context, as packed numbers. The reducer of a bucket merges them and writes one file of sorted hash arrays, with
the contexts' totals and numbers of followers seen once, twice and more often;
it passes on how many distinct words precede each shorter n-gram, which is
counted the same way, one order after another in one job. Files are named by
level and bucket, so nothing but counts of counts comes to the driver.

Contexts of the commonest words only would bring a row per follower and block to
one reducer. They are dealt out by their last word too: their followers lie
wherever these go, and their totals, summed over all buckets, are a table of
bounded size. Which words count as common makes no difference to the result.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.words import U64, Words, constants, mix, text_runs
from webloom.runtime import materialize, qualified, scratch_path

#: Hashes of the marks before and after a text: no words, so any values that are none's hash.
START, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
#: Tokens counted at a time, and for which a bucket is made.
BLOCK_TOKENS, BUCKET_TOKENS = 2 << 20, 3_000_000
#: Words are known by so many bits of their hashes: two of a billion words share them seven times.
WORD_MASK = U64((1 << 56) - 1)
#: A context seen once has 42 bits of its hash and 22 of its only follower's in one number: either is
#: taken for another one about once in four million lookups of unseen ones.
TAIL = U64(22)
TAIL_MASK = U64((1 << 22) - 1)
#: A word is common if it is more than one token in so many; so many of them are common in contexts of several words.
COMMON, COMMONEST = 1000, 64
#: Words that come first in a blob's dictionary, so that most ranks take one byte.
TOP = 255
#: Rows have a blob, or counts of counts of a level (level 0: of plain words), or (with ctx) sums of a common context.
NUMBERS = ("entries", "total", "n1", "n2", "n3", "n4")
SCHEMA = "level int, bucket int, blob binary, ctx long, " + ", ".join(f"{n} long" for n in NUMBERS)
_FIELDS = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("ctx", pa.int64()), *((n, pa.int64()) for n in NUMBERS)])


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of word hashes."""
    c = constants(len(columns), 17)
    total = columns[0] * c[0]
    for column, factor in zip(columns[1:], c[1:], strict=True):
        total = total + column * factor
    return mix(total)


@dataclass(frozen=True)
class Common:
    """Sorted numbers of common words, and of the commonest."""

    words: np.ndarray
    first: np.ndarray

    def contexts(self, columns: list[np.ndarray]) -> np.ndarray:
        """Which contexts hold common words only."""
        held = self.words if len(columns) == 1 else self.first
        return np.logical_and.reduce([held[np.minimum(np.searchsorted(held, c), len(held) - 1)] == c for c in columns])


def _routes(columns: list[np.ndarray], common: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n-grams of several words: their contexts' hashes, the hashes they are dealt out by, and which contexts are common."""
    contexts = gram_hashes(columns[:-1])
    often = common.contexts(columns[:-1])
    routes = contexts.copy()
    routes[often] = mix(contexts[often] ^ mix(columns[-1][often]))
    return contexts, routes, often


def _short(hashes: np.ndarray) -> np.ndarray:
    """The top bits of hashes mixed once more: within a bucket, a range of hashes, they are as different as anywhere."""
    return (mix(hashes ^ U64(0x5851F42D4C957F2D)) >> TAIL) << TAIL


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (((hashes >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def _keys(ranks: list[np.ndarray], size: int) -> np.ndarray:
    """A number for each row of ranks below size, in the rows' order."""
    key, limit = ranks[0].astype(np.int64), size
    for r in ranks[1:]:
        if limit * size >= 1 << 62:
            held, key = np.unique(key, return_inverse=True)
            limit = len(held)
        key = key * size + r
        limit *= size
    return key


def _planes(a: np.ndarray) -> tuple[bytes, int]:
    """The bytes of whole numbers in the smallest type that holds them, all first bytes together, then all second ones."""
    top = int(a.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    small = np.ascontiguousarray(a.astype(f"u{width}"))
    return small.view(np.uint8).reshape(-1, width).T.tobytes(), width


def _top_first(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the TOP ones of most weight before the others, and where each has gone."""
    top = np.zeros(len(words), dtype=bool)
    top[np.argpartition(-weight, TOP)[:TOP] if len(words) > TOP else slice(None)] = True
    order = np.concatenate([np.flatnonzero(top), np.flatnonzero(~top)])
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return words[order], place


def _pack(words: np.ndarray, ranks: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows of words by their ranks, in order; without ranks each word is a row."""
    first = [np.diff(ranks[0], prepend=0)] if ranks else []
    parts = [_planes(x) for x in (np.diff(words, prepend=U64(0)), *first, *ranks[1:], counts)]
    raw = b"".join(p[0] for p in parts)
    head = struct.pack("<QQQ", len(words), len(counts), len(raw)) + bytes([len(ranks), len(parts), *(p[1] for p in parts)])
    return head + pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    n_words, n, size = struct.unpack("<QQQ", blob[:24])
    width = blob[24]
    kinds = list(blob[26 : 26 + blob[25]])
    raw = np.frombuffer(pa.decompress(blob[26 + len(kinds) :], size, codec="zstd", asbytes=True), np.uint8)
    parts, at = [], 0
    for i, kind in enumerate(kinds):
        rows = n_words if i == 0 else n
        parts.append(np.ascontiguousarray(raw[at : at + rows * kind].reshape(kind, rows).T).view(f"u{kind}").ravel())
        at += rows * kind
    ranks = [np.cumsum(parts[1], dtype=np.int64), *parts[2 : width + 1]] if width else []
    return np.cumsum(parts[0], dtype=np.uint64), [r.astype(np.int32) for r in ranks], parts[-1].astype(np.int64)


def _deal(level: int, words: np.ndarray, ranks: list[np.ndarray], counts: np.ndarray, common: Common | None, buckets: int) -> Iterator[tuple]:
    """Rows (level, bucket, blob) of distinct n-grams in order, given by ranks of words."""
    columns = [words[r] for r in ranks]
    to = _bucket(_routes(columns, common)[1] if len(columns) > 1 else mix(columns[0]), buckets)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[b] : bounds[b + 1]]
        if len(ranks) == 1:
            yield level, int(b), _pack(columns[0][rows], [], counts[rows])
            continue
        part = [r[rows] for r in ranks]
        if len(rows) * 16 < len(words):
            held = np.unique(np.concatenate(part))
            part = [np.searchsorted(held, r) for r in part]
        else:
            used = np.zeros(len(words), dtype=bool)
            for r in part:
                used[r] = True
            held, place = np.flatnonzero(used), np.cumsum(used) - 1
            part = [place[r] for r in part]
        yield level, int(b), _pack(words[held], part, counts[rows])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def padded(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens with order - 1 start marks before and an end mark after each, and where each begins."""
    lengths = words.counts() + order
    first = np.concatenate([[0], np.cumsum(lengths)])
    tokens = np.full(first[-1], START, dtype=np.uint64)
    tokens[first[1:] - 1] = END
    shift = np.repeat(first[:-1] + order - 1 - words.first[:-1], words.counts())
    tokens[np.arange(len(words.hashes)) + shift] = words.hashes
    return tokens, first


def _ends(tokens: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Where the tokens are that are no start marks."""
    ends = np.ones(len(tokens), dtype=bool)
    for j in range(order - 1):
        ends[first[:-1] + j] = False
    return np.flatnonzero(ends)


@dataclass(frozen=True)
class Vocabulary:
    """Words by ranges of hashes: number = bucket * stride + place in the bucket's file; then the start mark's, and that of all others."""

    folder: str
    buckets: int
    stride: int

    @property
    def start(self) -> int:
        return self.buckets * self.stride

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of distinct words (by WORD_MASK)."""
        numbers, counts = np.full(len(words), self.start + 1, np.uint64), np.zeros(len(words), np.int64)
        for bucket, rows in _by_bucket(mix(words), self.buckets):
            file = open_bucket(self.folder, 0, bucket)
            if file is not None:
                hit, at = _place(file["keys"], words[rows])
                numbers[rows[hit]], counts[rows[hit]] = (at + bucket * self.stride).astype(np.uint64), _counts(file, at)
        numbers[words == START & WORD_MASK] = self.start
        return numbers, counts


def _count_words(buckets: int):
    """Distinct words of blocks with their counts, dealt out by hash."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        for row in _deal(0, words, [np.arange(len(words))], counts, None, buckets):
            yield _batch([(*row, *[None] * 7)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, run in text_runs(batch.column(0)):
                held += [Words(run).hashes & WORD_MASK, np.full(len(run), END & WORD_MASK)]
                size += len(held[-2]) + len(run)
                if size >= BLOCK_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return count


def _merge_words(folder: str):
    """Write a bucket's words; rows of its numbers, and (ctx: the place) of words that may be common in all."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        loaded = [_unpack(b) for b in table.column("blob").to_pylist()]
        _, (words, counts) = _merged(np.concatenate([x[0] for x in loaded]), [], *(np.concatenate([x[i] for x in loaded]) for i in (0, 2)), first=1)
        _write(folder, 0, bucket, {"keys": words, **_short_counts(counts)})
        often = np.flatnonzero(counts * COMMON > counts.sum())
        rows = [(0, bucket, None, None, len(words), int(counts.sum()), *[None] * 4)]
        rows += [(0, bucket, None, int(i), None, int(counts[i]), *[None] * 4) for i in often]
        return pa.Table.from_batches([_batch(rows)])

    return merge


def _count(order: int, buckets: int, common: Common, vocabulary: Vocabulary):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for t, _ in held])
        begins = np.cumsum([0, *(len(t) for t, _ in held[:-1])])
        at = np.concatenate([ends + b for (_, ends), b in zip(held, begins, strict=True)])
        words, of = np.unique(tokens & WORD_MASK, return_inverse=True)
        words = vocabulary.find(words)[0]
        by = np.argsort(words)
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        words, of = words[by], back[of]
        words, place = _top_first(words, np.bincount(of))
        rank = place[of]
        key = _keys([rank[at - (order - 1 - j)] for j in range(order)], len(words))
        _, one, counts = np.unique(key, return_index=True, return_counts=True)
        ranks = [rank[at[one] - (order - 1 - j)] for j in range(order)]
        rows = _deal(order, words, ranks, counts, common, buckets)
        for row in rows:
            yield _batch([(*row, *[None] * 7)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, run in text_runs(batch.column(0)):
                tokens, first = padded(Words(run), order)
                held.append((tokens, _ends(tokens, first, order)))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return count


def _short_counts(counts: np.ndarray, name: str = "count") -> dict[str, np.ndarray]:
    """Counts in a byte each, and those from 255 on by their places."""
    big = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": big, f"{name}_big": counts[big]}


def _counts(file: dict[str, np.ndarray], at: np.ndarray, name: str = "count") -> np.ndarray:
    out = file[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = file[f"{name}_big"][np.searchsorted(file[f"{name}_at"], at[big])]
    return out


def _smallest(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _write(folder: str, level: int, bucket: int, arrays: dict[str, np.ndarray]) -> None:
    """One file of a bucket's arrays; written aside and renamed, so that repeated attempts leave one whole file."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    aside = f"{base}/aside-{uuid.uuid4().hex}"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(struct.pack("<Q", len(text)) + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    system.move(aside, f"{base}/{level}-{bucket}")


def _views(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    begin = 8 + size
    return {name: raw[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in head.items()}


@lru_cache(maxsize=4096)
def _mapped(path: str) -> dict[str, np.ndarray] | None:
    try:
        return _views(np.asarray(np.memmap(path, dtype=np.uint8, mode="r")))
    except FileNotFoundError:
        return None


@lru_cache(maxsize=64)
def _fetched(path: str) -> dict[str, np.ndarray] | None:
    system, inner = fs.FileSystem.from_uri(path)
    try:
        with system.open_input_stream(inner, compression=None) as file:
            return _views(np.frombuffer(file.read(), dtype=np.uint8))
    except FileNotFoundError:
        return None


def open_bucket(folder: str, level: int, bucket: int) -> dict[str, np.ndarray] | None:
    """A bucket's arrays, mapped where the shared folder is a mounted one; else read, of 64 buckets at most."""
    path = f"{folder}/{level}-{bucket}"
    return _mapped(path.removeprefix("file://")) if path.startswith("file://") else _fetched(path)


def _reduce(folder: str, level: int, order: int, buckets: int, common: Common):
    """Merge and write the buckets of a level; other rows pass."""

    def reduce(table: pa.Table) -> pa.Table:
        own, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        if own != level or table.column("blob")[0].as_py() is None:
            return table
        loaded = [_unpack(b) for b in table.column("blob").to_pylist()]
        del table
        words = np.unique(np.concatenate([x[0] for x in loaded]))
        counts = np.concatenate([x[2] for x in loaded])
        to = [np.searchsorted(words, x[0]).astype(np.int32) for x in loaded]
        ranks = [np.concatenate([t[x[1][j]] if own > 1 else t for t, x in zip(to, loaded, strict=True)]) for j in range(own)]
        del loaded, to
        ranks, (counts,) = _merged(_keys(ranks, len(words)), ranks, counts)
        rows: list[tuple] = [(own, bucket, None, None, len(counts), int(counts.sum()), *(int((counts == n).sum()) for n in (1, 2, 3, 4)))]
        if own > 1:
            arrays, sums = _arrays([words[r] for r in ranks], counts, common)
            rows += [(own, bucket, None, *s, None) for s in sums]
            _write(folder, own, bucket, arrays)
            del arrays
            # words that go before: each distinct n-gram counts once for its last words
            words, place = _top_first(words, np.bincount(ranks[-1], minlength=len(words)))
            ranks = [place[r] for r in ranks[1:]]
            ranks, (before,) = _merged(_keys(ranks, len(words)), ranks, np.ones(len(counts), np.int64))
            rows += [(*row, *[None] * 7) for row in _deal(own - 1, words, ranks, before, common, buckets)]
        else:
            _write(folder, own, bucket, {"keys": words, **_short_counts(counts)})
        return pa.Table.from_batches([_batch(rows)])

    return reduce


def _merged(key: np.ndarray, ranks: list[np.ndarray], *counts: np.ndarray, first: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows in the order of their keys, and their counts added; of the leading `first` counts one is taken."""
    by = np.argsort(key)
    key = key[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [r[by[at]] for r in ranks], [c[by[at]] if i < first else np.add.reduceat(c[by], at) for i, c in enumerate(counts)]


def _arrays(columns: list[np.ndarray], counts: np.ndarray, common: Common) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """A bucket's arrays, from distinct n-grams in the order of their contexts; and (ctx, entries, total, n1, n2, n3) of common contexts."""
    contexts, _, often = _routes(columns, common)
    at = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    size = np.diff(np.append(at, len(contexts)))
    totals, ones, twos = (np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2))
    head, shared = contexts[at], often[at]
    kinds = np.stack([head.view(np.int64), size, totals, ones, twos, size - ones - twos])
    sums = [tuple(map(int, s)) for s in kinds[:, shared].T]
    # followers of common contexts, by the hash of the n-gram
    grams = gram_hashes([c[often] for c in columns])
    by = np.argsort(grams)
    arrays = {"often": grams[by], **_short_counts(counts[often][by], "often_count")}
    once = (size == 1) & (totals == 1) & ~shared
    arrays["once"] = np.sort(_short(head[once]) | (columns[-1][at[once]] & TAIL_MASK))
    rest = np.flatnonzero(~once & ~shared)
    rest = rest[np.argsort(head[rest])]
    arrays |= {"contexts": head[rest], **{n: _smallest(x[rest]) for n, x in (("totals", totals), ("ones", ones), ("twos", twos))}}
    arrays["starts"] = np.concatenate([[0], np.cumsum(size[rest])]).astype(np.uint32)
    # rows of the contexts in their new order, by the low half of their last words
    row = np.repeat(at[rest] - arrays["starts"][:-1], size[rest]) + np.arange(int(size[rest].sum()))
    if len(row) and int(columns[-1][row].max()) >> 32:
        raise OverflowError("more than 2**32 different words: followers are kept as 32-bit numbers")
    last = columns[-1][row].astype(np.uint32)
    by = np.lexsort((last, np.repeat(np.arange(len(rest)), size[rest])))
    return arrays | {"last": last[by], **_short_counts(counts[row[by]])}, sums


@dataclass(frozen=True)
class Model:
    """Files in folder; discounts[level] for counts 1, 2 and more; sums[level]: sorted contexts, totals and numbers of followers."""

    order: int
    buckets: int
    folder: str
    common: Common
    vocabulary: Vocabulary
    discounts: dict[int, tuple[float, float, float]]
    #: of level 1: the sum of its counts and the weight of what lies below it
    total: int
    rest: float
    train_tokens: int
    distinct: int
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; 0.5 each where the counts of counts don't give them."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    one = 1 - 2 * y * n2 / n1
    two = 2 - 3 * y * n3 / n2
    three = 3 - 4 * y * n4 / n3 if n3 else two
    return tuple(float(min(max(d, 0.05), top)) for d, top in zip((one, two, three), (1, 2, 3), strict=True))


def train(texts: DataFrame, text_col: str, order: int = 3, folder: str | None = None) -> Model:
    """Count all texts of a column (null: empty) and write the model's arrays into a shared folder."""
    spark = texts.sparkSession
    folder = qualified(spark, folder) if folder else scratch_path(spark, "ngrams")
    small_batches(spark)
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // (6 * BUCKET_TOKENS)))
    texts = texts.select(F.col(text_col).alias("text"))
    words = texts.mapInArrow(_count_words(buckets), SCHEMA).groupBy("bucket").applyInArrow(_merge_words(folder), SCHEMA)
    words = materialize(words.drop("blob"), "words")
    known = words.filter("ctx is null").agg(F.sum("entries").alias("entries"), F.sum("total").alias("total"), F.max("entries").alias("most")).first()
    vocabulary = Vocabulary(folder, buckets, int(known["most"] or 1))
    often = words.filter(F.col("ctx").isNotNull() & (F.col("total") * COMMON > (known["total"] or 0))).orderBy(F.desc("total"), "bucket", "ctx").limit(COMMON)
    numbers = np.array([vocabulary.start, *(r["bucket"] * vocabulary.stride + r["ctx"] for r in often.collect())], np.uint64)
    common = Common(np.sort(numbers), np.sort(numbers[:COMMONEST]))
    rows = texts.mapInArrow(_count(order, buckets, common, vocabulary), SCHEMA)
    for level in range(order, 0, -1):
        rows = rows.groupBy("level", "bucket", F.col("blob").isNull()).applyInArrow(_reduce(folder, level, order, buckets, common), SCHEMA)
    made = materialize(rows.drop("blob"), "counts")
    # a row a level, and one a common context of each
    about = {r["level"]: r for r in made.filter("ctx is null").groupBy("level").agg(*[F.sum(n).alias(n) for n in NUMBERS]).collect()}
    often = made.filter("ctx is not null").groupBy("level", "ctx").agg(*[F.sum(n).alias(n) for n in ("total", "n1", "n2", "n3")]).toPandas()
    sums = {}
    for level, part in often.groupby("level"):
        contexts = part["ctx"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(contexts)
        sums[int(level)] = contexts[by], part[["total", "n1", "n2", "n3"]].to_numpy(np.int64)[by]
    of = lambda level, name: (about[level][name] or 0) if level in about else 0
    cut = {level: discounts(*(of(level, n) for n in ("n1", "n2", "n3", "n4"))) for level in range(1, order + 1)}
    total, one, two = of(1, "total"), of(1, "n1"), of(1, "n2")
    d = cut[1]
    rest = (d[0] * one + d[1] * two + d[2] * (of(1, "entries") - one - two)) / total if total else 1.0
    return Model(order, buckets, folder, common, vocabulary, cut, total, rest, int(known["total"] or 0), int(known["entries"] or 0), sums)


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the rows that go there, in the order of their hashes."""
    order = np.argsort(hashes)
    to = _bucket(hashes[order], buckets)
    bounds = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(to[a]), order[a:b]


def _place(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which queries are among sorted keys, and where."""
    at = np.searchsorted(keys, queries)
    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == queries) if len(keys) else np.zeros(0, np.int64)
    return hit, at[hit]


def _preceding(model: Model, words: np.ndarray) -> np.ndarray:
    """How many distinct words precede each word."""
    out = np.zeros(len(words), dtype=np.int64)
    for bucket, rows in _by_bucket(mix(words), model.buckets):
        file = open_bucket(model.folder, 1, bucket)
        if file is not None:
            hit, at = _place(file["keys"], words[rows])
            out[rows[hit]] = _counts(file, at)
    return out


def _follower(file: dict[str, np.ndarray], context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The counts of words among the followers of contexts, by bisection of all at once."""
    low, high = (file["starts"][context + i].astype(np.int64) for i in (0, 1))
    end, last, word = high.copy(), file["last"], word.astype(np.uint32)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        under = last[middle] < word[open_]
        low[open_[under]] = middle[under] + 1
        high[open_[~under]] = middle[~under]
    hit = np.flatnonzero(low < end)
    hit = hit[last[low[hit]] == word[hit]]
    out = np.zeros(len(word), np.int64)
    out[hit] = _counts(file, low[hit])
    return out


def _lookup(model: Model, level: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams: their counts; and of their contexts the totals and the numbers of followers seen once, twice and more often."""
    contexts, routes, often = _routes(columns, model.common)
    own, sums = np.zeros(len(contexts), np.int64), np.zeros((len(contexts), 4), np.int64)
    if level in model.sums:
        known, table = model.sums[level]
        rows = np.flatnonzero(often)
        hit, at = _place(known, contexts[rows])
        sums[rows[hit]] = table[at]
    for bucket, rows in _by_bucket(routes, model.buckets):
        file = open_bucket(model.folder, level, bucket)
        if file is None:
            continue
        shared = rows[often[rows]]
        hit, at = _place(file["often"], gram_hashes([c[shared] for c in columns]))
        own[shared[hit]] = _counts(file, at, "often_count")
        rows = rows[~often[rows]]
        head, once = contexts[rows], file["once"]
        short = _short(head)
        at = np.searchsorted(once, short)
        hit = np.flatnonzero(once[np.minimum(at, len(once) - 1)] >> TAIL == short >> TAIL) if len(once) else np.zeros(0, np.int64)
        own[rows[hit]] = once[at[hit]] & TAIL_MASK == columns[-1][rows[hit]] & TAIL_MASK
        sums[rows[hit]] = (1, 1, 0, 0)
        hit, at = _place(file["contexts"], head)
        own[rows[hit]] = _follower(file, at, columns[-1][rows[hit]])
        size = np.diff(file["starts"][np.stack([at, at + 1])].astype(np.int64), axis=0)[0]
        total, one, two = (file[n][at].astype(np.int64) for n in ("totals", "ones", "twos"))
        sums[rows[hit]] = np.stack([total, one, two, size - one - two], axis=1)
    return own, sums


def _discounted(counts: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *cut])[np.minimum(counts, 3)], 0)


def probabilities(model: Model, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens at ends: the model's probability after those before them, and the plain count."""
    word, of = np.unique(tokens & WORD_MASK, return_inverse=True)
    numbers, counts = model.vocabulary.find(word)
    plain, seen = counts[of[ends]], _preceding(model, numbers)[of[ends]]
    tokens = numbers[of]
    columns = [tokens[ends - (model.order - 1 - j)] for j in range(model.order)]
    p = np.full(len(ends), model.rest / (model.distinct + 1))
    if model.total:
        p += _discounted(seen, model.discounts[1]) / model.total
    for level in range(2, model.order + 1):
        own, sums = _lookup(model, level, columns[-level:])
        known = np.flatnonzero(sums[:, 0])
        rest = sums[known, 1:] @ np.array(model.discounts[level])
        p[known] = (_discounted(own[known], model.discounts[level]) + rest * p[known]) / sums[known, 0]
    return p, plain


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in text_runs(batch.column(1), 4 << 20):
                tokens, first = padded(Words(run), model.order)
                ends = _ends(tokens, first, model.order)
                p, plain = probabilities(model, tokens, ends)
                begin = first - np.arange(len(first)) * (model.order - 1)
                base = np.log10((plain + 1) / (model.train_tokens + model.distinct + 1))
                sums = [np.add.reduceat(x, begin[:-1]) for x in (base, np.log10(p), (plain > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(run)) for i in (0, 2)), pa.array(np.diff(begin)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return score


def score_texts(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row per input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def language_model_scores(docs: DataFrame, order: int = 3, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents that are not held out and score all of them.

    A document is held out if the crc32 of its id as text is held_fold modulo
    folds; one with a null id never is. Tokens are the words of the text with
    A-Z lower-cased and one end mark; a null or empty text has the end mark
    only. score is the log10 probability of the tokens under the interpolated
    modified Kneser-Ney model, base_score that under add-one word counts. Words
    are told apart by 56 bits of their hashes; see TAIL for contexts seen once. A text of any length is taken whole. Repeated rows count and are scored each on their own. An empty table gives
    an empty result; other columns are not read.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    model = train(docs.filter(~held), text_col, order)
    return score_texts(docs, model, held, id_col, text_col)
