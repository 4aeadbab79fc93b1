"""Near-duplicate documents by b-bit MinHash, with links confirmed on full sets of shingles.

Documents with equal sets are one class. Classes whose minima agree on all rows
of some band share a bucket. Each bucket first links its members to its smallest
one; where that leaves members in several components, pairs across components
follow. Pairs are screened by the collision-corrected similarity that bit counts
of the packed signatures give, far below the threshold, and then confirmed on
the full sets. Pairs inside one component need no check: they add no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.words import U64, Words, constants, mix, shingles, text_runs
from webloom.operators.components import connected_components
from webloom.runtime import materialize


#: Rows of a bucket, and shingles of them, that are compared with as many others at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Members of a bucket that meet one copy of its smallest document's signature and text.
STAR_ROWS = 256


@dataclass(frozen=True)
class MinHash:
    """Parameters. At a Jaccard similarity of 0.8, 24 bands of 4 rows miss a pair once in 300,000."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    bits: int = 4
    #: Pairs estimated this far below the threshold are not checked: five standard errors of 96 minima.
    margin: float = 0.22


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for _, run in text_runs(texts):
        words = Words(run)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield np.unique(shingles(words.hashes[a:b], k))


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The minima of n hashes over each non-empty set: an array of sets by hashes."""
    factors, flips = constants(n, 3), constants(n, 5)
    out = np.empty((len(sets), n), dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 1 << 16:
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]])
        buffer = np.empty_like(flat)
        for j in range(n):
            np.bitwise_xor(flat, flips[j], out=buffer)
            np.multiply(buffer, factors[j], out=buffer)
            out[at:end, j] = np.minimum.reduceat(buffer, begins)
        at = end
    return out


def _pack(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    each = 64 // bits
    low = minima & U64((1 << bits) - 1)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % each)))
    low = low.reshape(len(low), low.shape[1] // each, each)
    return np.bitwise_or.reduce(low << (np.arange(each, dtype=np.uint64) * U64(bits)), axis=2)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    flat = pa.array(values.astype(np.uint64).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def signatures(docs: DataFrame, p: MinHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, packed) for every row; the last three null for empty sets."""
    n = p.bands * p.rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column(1), p.words))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                minima = _minima(full, n)
                banded = minima.reshape(len(full), p.bands, p.rows) * constants(p.rows, 7)
                bands = mix(banded.sum(axis=2, dtype=np.uint64) + constants(p.bands, 9))
                # two independent sums over the set make its key
                keys = [mix(s).sum(dtype=np.uint64).tobytes() + mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes() for s in full]
                where = pa.array(np.where(sizes > 0, np.cumsum(sizes > 0) - 1, -1))
                where = pc.if_else(pc.greater_equal(where, 0), where, None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(keys, pa.binary()).take(where), _lists(bands).take(where), _lists(_pack(minima, p.bits)).take(where)],
                    schema=schema,
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, packed array<long>")


def estimated(a: Column, b: Column, p: MinHash) -> Column:
    """Jaccard similarity from two packed signatures: matching b-bit values, less those expected by chance."""
    ones = sum(1 << (p.bits * i) for i in range(64 // p.bits))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def apart(x: Column, y: Column) -> Column:
        diff = x.bitwiseXOR(y)
        folded = diff
        for s in range(1, p.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(diff, s))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    n = p.bands * p.rows
    mismatches = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, x: s + x)
    chance = 0.5**p.bits
    return ((F.lit(float(n)) - mismatches) / n - chance) / (1 - chance)


def _both_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b, salt) with value of table (id, value) for both. A b of many pairs gives one copy to each of its salts."""
    of_a = table.select(F.col("id").alias("a"), F.col(value).alias(f"{value}_a"))
    of_b = table.select(F.col("id").alias("b"), F.col(value).alias(f"{value}_b"))
    dealt = pairs.select("b", "salt").distinct().join(of_b, "b")
    return pairs.join(of_a, "a").join(dealt, ["b", "salt"])


def confirm(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """Those (a, b) of pairs (a, b, salt) whose full sets in texts (id, text) are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if held is None or held[0] != b[i].as_py():
                    held = (b[i].as_py(), next(_sets(tb.slice(i, 1), p.words)))
                mine = next(_sets(ta.slice(i, 1), p.words))
                common = len(np.intersect1d(mine, held[1], assume_unique=True))
                if 100 * common >= p.percent * (len(mine) + len(held[1]) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    both = _both_sides(pairs, texts, "text").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long").distinct()


def _across(apart: DataFrame, p: MinHash, low: float) -> DataFrame:
    """Links (a, b) that join components within a bucket, from rows (bucket, blocks, doc_id, component, packed, text).

    A bucket is dealt into that many blocks, and each pair of blocks is compared
    on its own: first by bit counts, then exactly, all rows at once. Only links that join what was apart come out, so their number does
    not exceed that of the rows.
    """
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "packed", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in range(3)):
                    yield _links(held, p, low)
                    held = []
                held.append(part)
        if held:
            yield _links(held, p, low)

    keys = ["bucket", "i", "j"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def _links(parts: list[pa.RecordBatch], p: MinHash, low: float) -> pa.RecordBatch:
    """The links across components in one pair of blocks."""
    table = pa.Table.from_batches(parts).combine_chunks()
    own, ids, component = (table.column(c).to_numpy() for c in ("own", "doc_id", "component"))
    across = table.column("i")[0] != table.column("j")[0]
    bits = table.column("packed").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    ones = U64(sum(1 << (p.bits * i) for i in range(64 // p.bits)))
    mismatches = np.zeros((len(ids), len(ids)), dtype=np.int64)
    for word in bits.T:
        diff = word[:, None] ^ word[None, :]
        folded = diff.copy()
        for s in range(1, p.bits):
            folded |= diff >> U64(s)
        mismatches += np.bitwise_count(folded & ones)
    n, chance = p.bands * p.rows, 0.5**p.bits
    near = ((n - mismatches) / n - chance) / (1 - chance) >= low
    near &= component[:, None] != component[None, :]
    if across:
        near &= own[:, None] != own[None, :]
    rows = np.flatnonzero(near.any(axis=1))
    out: list[tuple[int, int]] = []
    if len(rows):
        sets = list(_sets(table.column("text").combine_chunks().take(pa.array(rows)), p.words))
        sizes = np.array([len(x) for x in sets])
        where = np.repeat(np.arange(len(sets)), sizes)
        _, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[of] > 1
        _, column = np.unique(of[shared], return_inverse=True)
        where, common = where[shared], np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, 4096):
            inside = (column >= at) & (column < at + 4096)
            held = np.zeros((len(sets), 4096), dtype=np.float32)
            held[where[inside], column[inside] - at] = 1
            common += held @ held.T
        common = common.astype(np.int64)
        linked = (100 * common >= p.percent * (sizes[:, None] + sizes[None, :] - common)) & near[np.ix_(rows, rows)]
        root = {int(c): int(c) for c in component[rows]}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in np.argwhere(np.triu(linked)):
            x, y = find(int(component[rows[a]])), find(int(component[rows[b]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(ids[rows[a]]), int(ids[rows[b]])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), a row per input row.

    Documents are linked if the Jaccard similarity of their sets of shingles of
    p.words words is p.percent hundredths or more; a text with fewer words is
    one shingle. component_id is the smallest id reachable by links, kept says
    that it is the row's own. class_id is the smallest id with the same set.
    Null and empty texts have no shingles and are linked with nothing. Rows that
    share an id are one node; rows with a null id are never linked and have a
    null component and kept false. An empty table gives an empty result; other
    columns are not read.
    """
    table = materialize(signatures(docs, p, id_col, text_col), "signatures")
    keyed = table.filter("set_key is not null and doc_id is not null")
    classes = materialize(keyed.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = classes.select("set_key", F.col("class_id").alias("doc_id")).join(keyed, ["set_key", "doc_id"])
    heads = materialize(heads.select("doc_id", "n_shingles", "bands", "packed"), "heads")

    rows = heads.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("size")).filter("least <> most")
    shared = materialize(shared.select(F.col("bucket").alias("_bucket"), "least", F.ceil(F.col("size") / STAR_ROWS).alias("salts")), "buckets")
    members = materialize(rows.join(shared, F.col("bucket") == F.col("_bucket")).select("bucket", "doc_id", "n_shingles", "least", "salts").distinct(), "members")
    ids = members.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # ids grow with the documents, so they are never broadcast
    texts = materialize(texts.join(ids.hint("merge"), F.col("id") == F.col("_id"), "left_semi"), "texts")

    low = p.percent / 100 - p.margin
    packed = heads.select(F.col("doc_id").alias("id"), F.col("packed"))
    stars = members.filter("doc_id <> least").groupBy(F.col("doc_id").alias("a"), F.col("least").alias("b")).agg(F.max("salts").alias("salts"))
    stars = materialize(stars.select("a", "b", F.pmod(F.xxhash64("a"), "salts").alias("salt")), "stars")
    stars = _both_sides(stars, packed, "packed").filter(estimated(F.col("packed_a"), F.col("packed_b"), p) >= low).select("a", "b", "salt")
    stars = materialize(stars, "stars")
    links = materialize(confirm(stars, texts, p), "links")
    found = materialize(connected_components(links, "a", "b"), "components")

    labelled = members.join(found, members["doc_id"] == found["id"], "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    labelled = materialize(labelled, "labelled")
    about = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("same"))
    # bands often gather the same documents: one bucket of each such set is enough
    mixed = about.filter("x <> y").groupBy("same", "n").agg(F.min("bucket").alias("_bucket"), F.max("size").alias("size"))
    mixed = mixed.select("_bucket", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    apart = labelled.join(materialize(mixed, "mixed"), F.col("bucket") == F.col("_bucket")).select("bucket", "blocks", "doc_id", "component")
    apart = apart.join(packed, F.col("doc_id") == F.col("id")).drop("id").join(texts, F.col("doc_id") == F.col("id")).drop("id")
    more = materialize(_across(apart, p, low), "links")
    if more.limit(1).count():
        found = materialize(connected_components(links.unionByName(more), "a", "b"), "components")

    own = classes.join(found, F.col("class_id") == F.col("id"), "left").select(F.col("set_key").alias("_key"), "class_id", "component")
    out = table.join(materialize(own, "classes"), F.col("set_key") == F.col("_key"), "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", class_id.alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")
    )
