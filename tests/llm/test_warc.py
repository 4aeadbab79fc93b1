import gzip
import hashlib
import io
import random

import pytest

from webloom.llm import warc


def record(n, body=b"x" * 300):
    return warc.encode_record(n, body, hashlib.sha256(body).hexdigest(), None)


def walk(data):
    out = list(warc.salvage(io.BytesIO(data)))
    return [warc._page(w["head"]["warc-record-id"]) for k, _, _, w in out if k == "record"], [(a, b) for k, a, b, _ in out if k == "gap"]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_salvage_recovers_what_follows_damage(zipped, chunk, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.randrange(600)) for _ in range(9)]
    members = [gzip.compress(record(i, b), mtime=0) if zipped else record(i, b) for i, b in enumerate(bodies)]
    whole = b"".join(members)
    assert walk(whole) == (list(range(9)), [])
    starts = [sum(map(len, members[:i])) for i in range(10)]
    broken = bytearray(whole)
    at = starts[4] - 12
    broken[at : at + 4] = bytes(255 - x for x in broken[at : at + 4])
    assert walk(bytes(broken)) == ([0, 1, 2, 4, 5, 6, 7, 8], [(starts[3], starts[4])])
    cut = whole[: starts[2]] + members[2][: len(members[2]) // 2] + b"".join(members[3:])
    pages, gaps = walk(cut)
    assert pages == [0, 1, 3, 4, 5, 6, 7, 8] and gaps == [(starts[2], starts[2] + len(members[2]) // 2)]
    assert walk(b"junk" + whole) == (list(range(9)), [(0, 4)])
    pages, gaps = walk(whole[:-9])
    if zipped:  # only the end of the member is lost: its record is whole and its digest right
        assert pages == list(range(9)) and [b for _, b in gaps] == [len(whole) - 9]
    else:
        assert pages == list(range(8)) and gaps == [(starts[8], len(whole) - 9)]
    assert walk(b"") == ([], [])


def test_a_length_that_is_too_long_hides_no_later_record():
    bad = record(1).replace(b"Content-Length: 300", b"Content-Length: 900")
    assert walk(record(0) + bad + record(2) + record(3))[0] == [0, 2, 3]


def test_round_trip(spark, tmp_path):
    long = "é" * 5000
    rows = [(5, "u", long), (3, "u", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "u", long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, payload string, html string")
    archives = warc.archive_pages(pages, str(tmp_path / "w"))
    got = warc.read_archives(archives)
    assert got.filter("kind = 'gap'").count() == 0
    found = sorted(map(tuple, got.select("page_id", "payload_bytes", "record_type", "refers_to", "payload").collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = 3 if data == long.encode() and i != 3 else None
        want.append((i, len(data), "revisit" if first else "response", first, None if first else bytearray(data)))
    assert found == sorted(want, key=str)
    assert warc.read_archives(warc.archive_pages(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_a_member_of_many_records_gives_what_is_sound():
    rng = random.Random(5)
    bodies = [rng.randbytes(3000) for _ in range(6)]
    records = [record(i, b) for i, b in enumerate(bodies)]
    bad = records[2].replace(bodies[2][100:108], b"damaged!")
    member = gzip.compress(b"".join([*records[:2], bad, *records[3:]]), mtime=0)
    out = list(warc.salvage(io.BytesIO(member)))
    assert [warc._page(w["head"]["warc-record-id"]) for k, _, _, w in out if k == "record"] == [0, 1, 3, 4, 5]
    inner = [w for k, _, _, w in out if k == "inner gap"]
    start = len(records[0]) + len(records[1])
    assert inner == [("warc-block-digest differs", start, start + len(bad))] and not any(k == "gap" for k, *_ in out)
    whole, later = gzip.compress(b"".join(records), mtime=0), gzip.compress(record(9), mtime=0)
    for cut, kept in ((40, 5), (len(whole) // 2, 2)):
        out = list(warc.salvage(io.BytesIO(whole[:-cut] + later + record(10))))
        assert [warc._page(w["head"]["warc-record-id"]) for k, _, _, w in out if k == "record"] == [*range(kept), 9, 10]
        assert [b for k, _, b, _ in out if k == "gap"] == [len(whole) - cut]
    out = list(warc.salvage(io.BytesIO(whole[:-40])))
    assert sum(k == "record" for k, *_ in out) == 5 and out[-1][0] == "gap" and out[-1][2] == len(whole) - 40


@pytest.mark.parametrize("zipped", [True, False])
def test_long_blocks_are_read_and_not_held(zipped, monkeypatch):
    for name, value in (("CHUNK", 1000), ("HELD", 3000), ("PIECE", 100)):
        monkeypatch.setattr(warc, name, value)
    body = random.Random(6).randbytes(50_000)
    pack = (lambda x: gzip.compress(x, mtime=0)) if zipped else (lambda x: x)
    wrong = record(1, body).replace(b"Content-Length: 50000", b"Content-Length: 50900")
    data = b"".join(pack(x) for x in (record(0, body), wrong, record(2), record(3, body)))
    for bodies in (True, False):
        rows = [w for k, _, _, w in warc.salvage(io.BytesIO(data), bodies) if k == "record"]
        assert [warc._page(w["head"]["warc-record-id"]) for w in rows] == [0, 2, 3]
        assert [w["length"] for w in rows] == [50_000, 300, 50_000] and (rows[0]["body"] == body if bodies else rows[0]["body"] is None)


def test_digests_of_other_kinds():
    one = record(0).replace(b"Block-Digest: sha256:", b"Block-Digest: SHA-256:")
    assert walk(one + record(1))[0] == [0, 1]
    assert walk(one.replace(b"x" * 300, b"y" * 300) + record(1))[0] == [1]
    sha1 = b"sha1:" + __import__("base64").b32encode(hashlib.sha1(b"x" * 300).digest())
    other = b"\r\n".join(b"WARC-Block-Digest: " + sha1 if line.startswith(b"WARC-Block") else line for line in record(2).split(b"\r\n") if not line.startswith(b"WARC-Payload-D"))
    assert walk(other)[0] == [2] and walk(other.replace(b"x" * 300, b"y" * 300))[0] == []


def test_gaps_of_archives_are_rows(spark, tmp_path):
    bad = record(2).replace(b"x" * 300, b"y" * 300)
    data = gzip.compress(record(1) + bad + record(3), mtime=0)
    (tmp_path / "a.warc.gz").write_bytes(data + b"junk" + gzip.compress(record(4), mtime=0))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.warc.gz", "b.warc.gz")], "archive string")
    rows = warc.read_archives(paths).collect()
    assert sorted(r["page_id"] for r in rows if r["kind"] == "record") == [1, 3, 4]
    gaps = sorted((r["start"], r["end"], r["inner_start"], r["inner_end"]) for r in rows if r["kind"] == "gap")
    assert gaps == [(0, len(data), len(record(1)), len(record(1)) + len(bad)), (len(data), len(data) + 4, None, None)]
