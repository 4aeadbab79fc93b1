"""Token ids of documents in bit-packed files.

Fixed-width packing: each id takes the bits that the largest id of the
vocabulary needs (16 for 49,408 ids). 64 ids are as many 64-bit words as an id
has bits, so numpy packs and unpacks all groups of 64 at once, a lane at a time,
and a block of ids begins at a byte that the file states: any document can be
read without what stands before it.

A file is, in little-endian order:

- the packed blocks, BLOCK ids each (the last one may be shorter);
- offsets: for each block, where it begins, and where the last one ends (uint64);
- documents: for each, whether it has an id (uint64 0 or 1), its id (int64) and where its ids end, counted in ids (uint64);
- 48 bytes: bits an id, ids a block, ids, documents, blocks (uint64 each) and the 8 bytes of MAGIC.

Documents stand in ascending order of their ids, within files and from file to
file. Files are written by tasks under names of their own, and only what a
finished task returned is read, so a task that runs twice leaves an unused file
and no fault.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.llm.cuts import cut, ranges
from webloom.llm.words import text_runs
from webloom.operators.ordered import PART
from webloom.runtime import materialize, scratch_path, shuffle_partitions

MAGIC = b"WLBITS01"
#: Ids in a block; a multiple of 64.
BLOCK = 1 << 16
#: Ids in a file, about: a file ends with the document that reaches this many.
FILE_IDS = 1 << 26
#: Encoded words that a worker remembers (twice as many at most).
REMEMBERED = 500_000
_TAIL = struct.Struct("<5Q8s")


def width(ids: int) -> int:
    """Bits that the ids from 0 to ids - 1 need."""
    return max(1, (ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at bits each, the lowest bits first, without space between them."""
    n = len(ids)
    groups = -(-n // 64)
    lanes = np.zeros((groups, 64), dtype=np.uint64)
    lanes.ravel()[:n] = ids
    words = np.zeros((groups, bits), dtype="<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.tobytes()[: -(-n * bits // 8)]


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that pack() put into raw."""
    groups = -(-n // 64)
    words = np.frombuffer(raw.ljust(groups * bits * 8, b"\0"), dtype="<u8", count=groups * bits).reshape(groups, bits)
    lanes = np.empty((groups, 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.ravel()[:n]


class Writer:
    """One file; ids wait until they fill a block."""

    def __init__(self, path: str, bits: int) -> None:
        self.path, self.bits = path, bits
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(place, compression=None)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.offsets = [0]
        self.known: list[int] = []
        self.names: list[int] = []
        self.stops: list[int] = []

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.known.append(name is not None)
        self.names.append(name or 0)
        self.stops.append(self.ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.waiting)
            whole = self.held - self.held % BLOCK
            for at in range(0, whole, BLOCK):
                self._block(every[at : at + BLOCK])
            self.waiting, self.held = [every[whole:].copy()], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> tuple[str, int]:
        """Path of the file and number of its ids."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        for column, kind in ((self.offsets, "<u8"), (self.known, "<u8"), (self.names, "<i8"), (self.stops, "<u8")):
            self.out.write(np.array(column, dtype=kind).tobytes())
        self.out.write(_TAIL.pack(self.bits, BLOCK, self.ids, len(self.names), len(self.offsets) - 1, MAGIC))
        self.out.close()
        return self.path, self.ids


class Reader:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        self.bits, self.block, self.ids, docs, blocks, magic = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        index = self._at(size - _TAIL.size - 8 * (blocks + 1 + 3 * docs), 8 * (blocks + 1 + 3 * docs))
        self.offsets = np.frombuffer(index, dtype="<u8", count=blocks + 1).astype(np.int64)
        self.known, names, stops = np.frombuffer(index, dtype="<u8", offset=8 * (blocks + 1)).reshape(3, docs)
        self.names = names.view("<i8")
        self.stops = stops.astype(np.int64)
        self.starts = np.concatenate([[0], self.stops[:-1]]).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def pieces(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from start to stop, a block at a time; only blocks that hold some are read."""
        for b in range(start // self.block, -(-stop // self.block)):
            n = min(self.block, self.ids - b * self.block)
            ids = unpack(self._at(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b])), self.bits, n)
            yield ids[max(0, start - b * self.block) : stop - b * self.block]

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's document i."""
        found = list(self.pieces(int(self.starts[i]), int(self.stops[i])))
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """Each document's name, first id in the file, and ids in pieces; every block is read once."""
        blocks = self.pieces(0, self.ids)
        block, used = np.zeros(0, np.uint32), 0
        for known, name, start, stop in zip(self.known.tolist(), self.names.tolist(), self.starts.tolist(), self.stops.tolist(), strict=True):
            parts, missing = [], stop - start
            while missing:
                if used == len(block):
                    block, used = next(blocks), 0
                parts.append(block[used : used + missing])
                used += len(parts[-1])
                missing -= len(parts[-1])
            yield name if known else None, start, parts

    def close(self) -> None:
        self.file.close()


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    # a task has one core; threads of the library would only wait for each other
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@lru_cache(maxsize=2)
def _word_ends(definition: str) -> np.ndarray | None:
    """Which ids end a word, for tokenizers whose ids say so."""
    model = json.loads(definition)["model"]
    if not model.get("end_of_word_suffix"):
        return None
    found = np.zeros(_tokenizer(definition).get_vocab_size(with_added_tokens=True), dtype=bool)
    found[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
    return found


class _Encoder:
    """Ids of texts, by way of their words: each word is encoded once and remembered.

    Sound for tokenizers that drop white space and join nothing over it. The
    shortest text of each batch is encoded as a whole too; if that differs,
    the tokenizer is not of this kind, which is an error.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = _tokenizer(definition)
        self.ends = _word_ends(definition)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._encode(words)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Encode words of letters as one text, which is cheaper, and cut its ids where words end.

        Each word ends at least once, so as many ends as words are one for each; else the words are encoded one by one.
        """
        if self.ends is None:
            return self._each(words)
        ids = np.array(self._encode([" ".join(words)])[0], dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._each(words)
        raw, places = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def _look_up(self, words: list[str]) -> list[bytes]:
        found = [self.new.get(w) or self.old.get(w) for w in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        letters = [i for i in missing if words[i].isalpha()]
        others = [i for i in missing if not words[i].isalpha()]
        for some, encode in ((letters, self._together), (others, self._each)):
            for at in range(0, len(some), 2000):
                part = some[at : at + 2000]
                for i, ids in zip(part, encode([words[i] for i in part]), strict=True):
                    found[i] = self.new[words[i]] = ids
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin."""
        found = cut(texts)
        words = found.words.dictionary_encode()
        each = self._look_up(words.dictionary.to_pylist())
        sizes = np.fromiter((len(b) >> 2 for b in each), dtype=np.int64, count=len(each))
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids, of = np.frombuffer(b"".join(each), dtype="<u4"), words.indices.to_numpy()
        ids = ids[ranges(begins[of], sizes[of])]
        stops = np.concatenate([[0], np.cumsum(sizes[of])])[found.first]
        if len(texts):
            i = int(np.argmin(np.diff(found.stops)))
            whole = self._encode([texts[i].as_py() or ""])[0]
            if whole != ids[stops[i] : stops[i + 1]].tolist():
                raise ValueError("this tokenizer joins words over white space; use by_word=False")
        return ids, stops


class _WholeEncoder(_Encoder):
    """Ids of whole texts, for any tokenizer."""

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = self._encode(["" if t is None else t for t in texts.to_pylist()])
        stops = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
        return np.fromiter((i for e in each for i in e), dtype=np.uint32, count=int(stops[-1])), stops


_encoders: dict[tuple[int, bool], _Encoder] = {}


def _encoder(definition: str, by_word: bool) -> _Encoder:
    """The worker's encoder, which lives as long as the worker, so that words stay known from task to task."""
    key = (hash(definition), by_word)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (_Encoder if by_word else _WholeEncoder)(definition)
    return _encoders[key]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write their ids into files; a row per file: path, _part, number in the part, and ids.

    tokenizer is the path of a tokenizer's definition, which the driver reads and
    sends along with the tasks. After each document stands end_id. Documents
    stand in the order of their whole-number ids, null ones last; rows of one id
    are told apart by their texts' hashes. A null text is an empty one. An empty
    table makes no file.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    spark = docs.sparkSession
    bits = width(max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True), end_id + 1))
    small_batches(spark)
    folder = scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64("text")]
    # equal rows may stand in any order, so a number of no meaning keeps them from one range
    dealt = rows.withColumn("_n", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, F.col("_n")).sortWithinPartitions(*order, F.col("_n"))
    dealt = dealt.select("id", "text", F.spark_partition_id().alias(PART))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(definition, by_word)
        end = np.array([end_id], dtype=np.uint32)
        files: list[tuple[str, int]] = []
        writer, part = None, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if len(batch) else part
            for at, texts in text_runs(batch.column(1), 8 << 20):
                ids, stops = encode(texts)
                for i, name in enumerate(names[at : at + len(texts)]):
                    writer = writer or Writer(f"{folder}/{uuid.uuid4().hex}", bits)
                    writer.add(name, np.concatenate([ids[stops[i] : stops[i + 1]], end]))
                    if writer.ids >= FILE_IDS:
                        files.append(writer.close())
                        writer = None
        if writer:
            files.append(writer.close())
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([f[0] for f in files], pa.string()),
                PART: pa.array([part] * len(files), pa.int32()),
                "number": pa.array(range(len(files)), pa.int32()),
                "ids": pa.array([f[1] for f in files], pa.int64()),
            }
        )

    return materialize(dealt.mapInArrow(write, f"path string, {PART} int, number int, ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, file_path and file_start (its first id in the file).

    start counts the ids of all files before it in the order of _part and number.
    Each file is read a block at a time, where it lies; no document is joined.
    """
    small_batches(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(path)
                rows: list[tuple[int | None, int, int, int]] = []
                for name, start, parts in reader.documents():
                    crc = 0
                    for part in parts:
                        crc = zlib.crc32(np.ascontiguousarray(part, dtype="<u4"), crc)
                    rows.append((name, start, sum(map(len, parts)), crc))
                    if len(rows) == 10_000:
                        yield _found(path, before, rows)
                        rows = []
                yield _found(path, before, rows)
                reader.close()

    # a row per file of 64 million ids or per range partition: few enough for one window
    upto = Window.orderBy(PART, "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("ids").over(upto), F.lit(0)).alias("before"))
    placed = placed.repartition(shuffle_partitions(files.sparkSession), "path")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file_path string, file_start long")


def _found(path: str, before: int, rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    names, starts, counts, crcs = (pa.array(c, pa.int64()) for c in columns)
    begun = pa.array(np.array(columns[1], dtype=np.int64) + before, pa.int64())
    return pa.RecordBatch.from_arrays(
        [names, begun, counts, crcs, pa.array([path] * len(rows), pa.string()), starts],
        ["doc_id", "start", "n_tokens", "ids_crc32", "file_path", "file_start"],
    )


def token_index(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back; see write_token_files() for nulls, repeats and empty tables, read_token_files() for the columns."""
    return read_token_files(write_token_files(docs, tokenizer, end_id, by_word, id_col, text_col))
