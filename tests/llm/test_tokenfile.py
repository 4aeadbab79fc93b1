"""Packed token files: round trips, random access, and ids as the tokenizer gives them for whole texts."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import queries, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 15, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        raw = tokenfile.pack(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert tokenfile.unpack(raw, bits, n).tolist() == ids.tolist()
        # the bits stand one after another, lowest first
        assert int.from_bytes(raw, "little") == sum(int(x) << (bits * i) for i, x in enumerate(ids))


def test_width():
    assert [tokenfile.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 128)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 17, n, dtype=np.uint32) for n in (0, 1, 127, 128, 129, 1000, 0, 5)]
    writer = tokenfile.Writer(f"file://{tmp_path}/a/tokens", 17)
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else i - 2, ids)
    path, n = writer.close()
    reader = tokenfile.Reader(path)
    assert n == reader.ids == sum(map(len, docs)) and len(reader.offsets) == 1 + -(-n // 128)
    for i in random.Random(2).sample(range(len(docs)), len(docs)):
        assert reader.document(i).tolist() == docs[i].tolist()
    again = [(name, start, np.concatenate([*parts, np.zeros(0, np.uint32)]).tolist()) for name, start, parts in reader.documents()]
    starts = np.cumsum([0, *map(len, docs)])
    assert again == [(None if i == 3 else i - 2, starts[i], docs[i].tolist()) for i in range(len(docs))]
    reader.close()
    (tmp_path / "other").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        tokenfile.Reader(f"file://{tmp_path}/other")


def test_query_against_the_tokenizer(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    odd = ["don't", "Élan!!", "é", "́x", "12,5", "<|endoftext|>", "<|startoftext|>x", "x y", "　", "漢字", "🙂", "'s", "ß", "\x00", "İ", "a" * 300]
    texts = [None, "", " \t\n", "<|endoftext|> x", *(rng.choice(["", " "]) + "".join(rng.choice(odd) + rng.choice([" ", "  ", "\n", "\t\r"]) for _ in range(rng.randint(1, 80))) for _ in range(80))]
    ids = rng.sample(range(-50, 1000), len(texts))
    spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, start string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, []
    for doc_id, text in sorted(zip(ids, texts, strict=True)):
        found = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(found), zlib.crc32(np.array(found, dtype="<u4").tobytes())))
        at += len(found)
    assert sorted(map(tuple, queries.op13_token_bits(spark, str(tmp_path)).collect())) == want
    whole = tokenfile.token_index(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH, end_id=2, by_word=False)
    assert sorted(tuple(r)[:4] for r in whole.collect()) == want


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 5)
    encode = tokenfile._Encoder(open(PATH, encoding="utf-8").read())
    for i in range(20):
        texts = pa.array([" ".join(f"w{i + j}" for j in range(3)), None, f"w{i} w{i}"])
        ids, stops = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(stops[:-1], stops[1:], strict=True)] == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert len(encode.new) + len(encode.old) <= 16


def test_a_tokenizer_that_keeps_white_space_is_refused(spark):
    docs = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(Exception, match="by_word=False"):
        tokenfile.token_index(docs, path, end_id=50256).collect()
    from tokenizers import Tokenizer

    row = tokenfile.token_index(docs, path, end_id=50256, by_word=False).first()
    found = [*Tokenizer.from_file(path).encode("two words", add_special_tokens=False).ids, 50256]
    assert row["ids_crc32"] == zlib.crc32(np.array(found, dtype="<u4").tobytes())
    assert tokenfile.width(json.loads(open(path, encoding="utf-8").read())["model"]["vocab"].__len__()) == 16


def test_null_and_repeated_ids_and_files_that_fill_up(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c"), (3, None), (None, "a")], "doc_id int, text string").coalesce(1)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenfile.token_index(docs, PATH, end_id=2).collect())
    assert [(r[1], r[2]) for r in got[3:]] == [(None, 2), (None, 2)]
    assert sorted(r[2] for r in got[:3]) == [1, 3, 3] and {r[1] for r in got[:3]} == {3}
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert tokenfile.token_index(docs.limit(0), PATH, end_id=2).count() == 0
    files = tokenfile.write_token_files(docs, PATH, 2)
    assert files.agg({"ids": "sum"}).first()[0] == 11
