"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import small_batches
from webloom.runtime import materialize, qualified, scratch_path

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
VERSIONS, MARKS = re.compile(re.escape(VERSION)), re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
#: Bytes read at a time, and of compressed records after which the writer begins a new file.
CHUNK, ROLL = 1 << 18, 32 << 20
#: Packed bytes unpacked at a time, and bytes of a record kept for a new search after a failed check.
PIECE, HELD = 1 << 14, 4 << 20
#: No header block is longer than this; a longer one is damage.
HEADER_LIMIT = 1 << 16
#: What a gzip member is that ends as it should.
WHOLE = "whole member"
#: Payloads under this many bytes are always stored.
SMALL = 100
READ_SCHEMA = (
    "kind string, archive string, start long, end long, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary, reason string, inner_start long, inner_end long"
)


def encode_record(page_id: int | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record: a revisit of the page `first` where that is given, else a response."""
    body = b"" if first is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(body)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, payload, digest, first): first is the page that holds an equal payload, null for responses.

    Of payloads of at least SMALL bytes that are equal, the one with the
    smallest page_id is stored. Null payloads are empty ones; rows with a null
    id are revisits only of pages with one. Repeats of the storing row's id with
    the same payload are stored again.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= SMALL)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    # written, so that the join has plain exchanges and the copies of one payload can be split
    groups = materialize(groups.select(F.col("digest").alias("_digest"), F.col("first")), "payloads")
    joined = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    first = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "payload", "digest", first.alias("first"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records of plan_records() into archives under folder; (archive, records), a row a file.

    Each attempt of a task writes files of its own names; the result lists only
    those of attempts that ended well, so a lost executor leaves at most files
    that nothing reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, payload, digest, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(encode_record(page_id.as_py(), payload.as_py(), digest.as_py(), first.as_py()), 3, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ROLL:
                    out.close()
                    out = done.append((f"{folder}/{name}", count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    small_batches(records.sparkSession, rows=500)
    return records.mapInArrow(write, "archive string, records long")


class _Bytes:
    """A stream's bytes from a moving start, read as needed; open_at(offset) gives the stream from there on."""

    def __init__(self, open_at: Callable[[int], BinaryIO]) -> None:
        self.open_at, self.file = open_at, open_at(0)
        self.base, self.held, self.ended = 0, bytearray(), False

    def upto(self, end: int) -> bool:
        """Hold the bytes before `end`; False if the stream ends earlier."""
        while self.base + len(self.held) < end and not self.ended:
            got = self.file.read(CHUNK)
            self.ended = not got
            self.held += got
        return self.base + len(self.held) >= end

    def end(self) -> int:
        return self.base + len(self.held)

    def drop(self, start: int) -> None:
        """Let go of the bytes before start; another start is read anew."""
        if not self.base <= start <= self.end():
            self.file, self.base, self.held, self.ended = self.open_at(start), start, bytearray(), False
        else:
            del self.held[: start - self.base]
            self.base = start

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.held[start - self.base : end - self.base])

    def find(self, start: int, marks: re.Pattern) -> int:
        """The first mark at or after start, or -1; bytes before it are let go."""
        self.drop(start)
        while True:
            found = marks.search(self.held)
            if found:
                self.drop(self.base + found.start())
                return self.base
            self.drop(max(self.base, self.end() - len(VERSION) + 1))
            if not self.upto(self.end() + 1):
                return -1


class Damaged(Exception):
    """What a check found."""


def _digest(value: str) -> tuple[str, str] | None:
    """Name and value of a digest that hashlib can check, else None."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("sha-", "sha")
    return (name, text.strip()) if name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512") else None


def _same(sum_: bytes, text: str) -> bool:
    """Whether a digest is written as text, in hexadecimal or base 32."""
    return text.lower() == sum_.hex() or text.upper().rstrip("=") == base64.b32encode(sum_).decode().rstrip("=")


def _parse(text: _Bytes, start: int, bodies: bool) -> tuple[dict, int]:
    """The record that begins at start, checked, and where it ends; bytes before start may be let go.

    A block is hashed piece by piece, so that a long one, or a wrong length,
    needs no memory; it is kept only if asked for.
    """
    if text.get(start, start + len(VERSION)) != VERSION:
        raise Damaged("no version line")
    text.upto(start + HEADER_LIMIT)
    stop = text.held.find(b"\r\n\r\n", start - text.base, start - text.base + HEADER_LIMIT)
    if stop < 0:
        raise Damaged("endless header")
    stop += text.base
    try:
        lines = text.get(start, stop).decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        length = int(head["content-length"])
    except (ValueError, KeyError):
        raise Damaged("bad header") from None
    if length < 0:
        raise Damaged("bad length")
    names = ["warc-block-digest", *(["warc-payload-digest"] if head.get("warc-type") == "response" else [])]
    checks = [(n, *d) for n in names if (d := _digest(head.get(n, "")))]
    sums = {kind: hashlib.new(kind) for kind in {"sha256", *(c[1] for c in checks)}}
    parts, at, end = [], stop + 4, stop + 4 + length
    while at < end:
        piece = text.get(at, min(at + CHUNK, end))
        if not piece:
            raise Damaged("bad length")
        for one in sums.values():
            one.update(piece)
        if bodies:
            parts.append(piece)
        at += len(piece)
        if at - text.base > HELD:
            text.drop(at)
    if text.get(end, end + 4) != b"\r\n\r\n":
        raise Damaged("bad length")
    for name, kind, value in checks:
        if not _same(sums[kind].digest(), value):
            raise Damaged(f"{name} differs")
    return {"head": head, "body": b"".join(parts) if bodies else None, "length": length, "sha256": sums["sha256"].hexdigest()}, end + 4


class _At:
    """A file read from an offset on, however else it is used."""

    def __init__(self, file: BinaryIO, offset: int) -> None:
        self.file, self.offset = file, offset

    def read(self, most: int) -> bytes:
        self.file.seek(self.offset)
        got = self.file.read(most)
        self.offset += len(got)
        return got


class _Member:
    """The unpacked bytes of the gzip member that begins at start, as far as they can be had."""

    def __init__(self, data: _Bytes, file: BinaryIO, start: int) -> None:
        self.data, self.file, self.start = data, file, start

    def open_at(self, offset: int) -> _Member:
        self.unzip, self.at, self.size, self.tail, self.state = zlib.decompressobj(31), self.start, 0, b"", ""
        #: unpacked and packed bytes before each piece
        self.pieces: deque[tuple[int, int]] = deque()
        while self.size < offset and self.read(min(offset - self.size, CHUNK)):
            pass
        return self

    def read(self, most: int) -> bytes:
        """Up to `most` further bytes; none at the end, when state tells what it is."""
        while not self.state:
            # all output of the pieces so far comes before the next one is read
            if not self.tail and (out := self.unzip.decompress(b"", most)):
                self.size += len(out)
                return out
            piece = self.tail or self._next()
            if not piece:
                self.state = "cut member"
                break
            before = self.unzip.copy()
            try:
                out = self.unzip.decompress(piece, most)
                self.tail = self.unzip.unconsumed_tail
            except zlib.error:
                out, self.state = self._sound(before, piece), "broken member"
            if self.unzip.eof:
                self.state, self.tail = WHOLE, b""
                self.at -= len(self.unzip.unused_data)
            if out:
                self.size += len(out)
                return out
        return b""

    def packed(self, unpacked: int) -> int:
        """Where the packed bytes can't end earlier that give so many unpacked ones."""
        while len(self.pieces) > 1 and self.pieces[1][0] <= unpacked:
            self.pieces.popleft()
        return self.pieces[0][1] if self.pieces and self.pieces[0][0] <= unpacked else self.start

    def _next(self) -> bytes:
        if self.data.base <= self.at < self.data.end():
            got = bytes(self.data.held[self.at - self.data.base : self.at - self.data.base + PIECE])
        else:
            got = _At(self.file, self.at).read(PIECE)
        if got:
            self.pieces.append((self.size, self.at))
        self.at += len(got)
        return got

    @staticmethod
    def _sound(unzip, piece: bytes) -> bytes:
        """What can be unpacked of a piece before its damage, byte by byte."""
        out = b""
        try:
            for i in range(len(piece)):
                out += unzip.decompress(piece[i : i + 1])
        except zlib.error:
            pass
        return out


def _records(data: _Bytes, bodies: bool, marks: re.Pattern, member: Callable[[int], Iterator[tuple]] | None = None) -> Iterator[tuple]:
    """Walk bytes from record to record; member(start), if given, walks what begins with gzip's magic."""
    at, gap, why = 0, None, ""
    while data.upto(at + 1):
        try:
            if member and data.get(at, at + len(MAGIC)) == MAGIC:
                rows, whole = member(at), True
            else:
                record, end = _parse(data, at, bodies)
                rows, whole = iter([("record", at, end, record), ("end", at, end, WHOLE)]), True
            found = False
            for kind, a, end, what in rows:
                if kind == "end":
                    whole, state = what == WHOLE, what
                    break
                if gap is not None:
                    yield "gap", gap, at, why
                    gap = None
                found = True
                yield kind, a, end, what
            if not found:
                raise Damaged(state)
            if whole:
                at = end
                data.drop(at)
                continue
            failed, reason = end, state
        except Damaged as damage:
            failed, reason, end = at, str(damage), at + 1
        if gap is None:
            gap, why = failed, reason
        at = data.find(end, marks)
        if at < 0:
            break
    if gap is not None:
        while data.upto(data.end() + 1):
            data.drop(data.end())
        if gap < data.end():
            yield "gap", gap, data.end(), why


def salvage(file: BinaryIO, bodies: bool = True) -> Iterator[tuple[str, int, int, dict | str | tuple]]:
    """Walk an archive of gzip members or plain records, whatever its state; file can be sought in.

    Yields ("record", start, end, record), for bytes in which no valid record
    begins ("gap", start, end, reason), and for such bytes inside a member that
    holds valid records ("inner gap", start, end, (reason, unpacked start,
    unpacked end)), start and end being the packed bytes read so far. After a
    failed check the next member or version line that holds a valid record is
    looked for from the byte after the failed start, so that a damaged length
    hides no later record; inside a member, from version line to version line.
    What a member gives before it breaks off is kept, and the search goes on
    from the packed bytes in which its last valid record ended. Records may be
    of any length; without bodies none is held in memory. Digests are checked
    if hashlib knows their kind, in hexadecimal or base 32; others are not.
    """
    data = _Bytes(lambda offset: _At(file, offset))

    def member(start: int) -> Iterator[tuple]:
        held = _Member(data, file, start)
        safe, last, found, why = start + 1, None, False, "no valid record"
        for kind, a, b, what in _records(_Bytes(held.open_at), bodies, VERSIONS):
            if kind == "record":
                found, safe = True, max(safe, held.packed(b))
            if last:
                yield last
            last = ("record", start, held.at, what) if kind == "record" else ("inner gap", start, held.at, (what, a, b))
            why = what if kind == "gap" else why
        whole = held.state == WHOLE
        if found:
            yield (*last[:2], held.at if whole else last[2], last[3])
        yield "end", start, held.at if whole else safe, held.state if found or not whole else why

    yield from _records(data, bodies, MARKS, member)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the archives named in column archive: rows of kind record and of kind gap.

    A gap row has the archive, the quarantined bytes' start and end and the
    reason of the first failed check; inner_start and inner_end are set for a
    gap in the unpacked bytes of the member there. A record row has the page,
    the digest and length of the full payload (computed from a response's body,
    declared by a revisit), and the payload if asked for. An empty file has no
    rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with system.open_input_file(path) as file:
                    for kind, start, end, what in salvage(file, payloads):
                        if kind != "record":
                            reason, *inner = what if kind == "inner gap" else (what, None, None)
                            rows.append(("gap", archive, start, end, *[None] * 6, reason, *inner))
                            continue
                        head = what["head"]
                        stored = head.get("warc-type") == "response"
                        digest = what["sha256"] if stored else head.get("warc-payload-digest", "").removeprefix("sha256:")
                        length = what["length"] if stored else int(head.get("x-payload-length", 0))
                        payload = what["body"] if stored else None
                        rows.append((kind, archive, start, end, _page(head.get("warc-record-id")), length, digest, head.get("warc-type"), _page(head.get("warc-refers-to")), payload, None, None, None))
                        size += len(payload or b"")
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    small_batches(archives.sparkSession)
    root = qualified(archives.sparkSession, "/").rstrip("/")
    names = archives.select(F.when(F.col("archive").startswith("/"), F.concat(F.lit(root), "archive")).otherwise(F.col("archive")).alias("archive"))
    # a fixed number of tasks: adaptive execution would join them, as paths are short
    names = names.repartition(min(10_000, max(1, names.count())))
    return names.mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Write pages as WARC archives into folder (by default one in the shared scratch folder); (archive, records)."""
    folder = qualified(pages.sparkSession, folder) if folder else scratch_path(pages.sparkSession, "warc")
    return materialize(write_archives(plan_records(pages, id_col, html_col), folder), "archives")
