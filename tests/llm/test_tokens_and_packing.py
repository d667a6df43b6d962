import random
import zlib

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import token_store as S
from quilt.llm.packing import binary_lengths, pack
from quilt.llm.tokens import Encoder, encoder, public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
LONG = "lorem ipsum " * 20000


def library(path, text):
    e = encoder(path)
    return e.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_equal_whole_texts(path):
    """The memo of units gives what the library gives for the whole text."""
    e, rng = Encoder(path), random.Random(5)
    assert e.kind is not None
    pool = [chr(c) for c in range(0x250)] + [chr(c) for c in (0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x301, 0x308, 0x3A3, 0x130, 0x1F600, 0xFEFF, 0x200B)]
    pool += ["'s", "'ll", " ", "  ", "\n", "\n\n", " \n", "<|endoftext|>", "</w>"] * 20
    latin = [chr(c) for c in (*range(0x80), *range(0xC0, 0x180))] + ["'s", "'LL", " ", "  ", "\n", "<|endoftext|>", "</w>"] * 10
    for chars in (pool, latin):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
        assert e.encode(texts) == e._library(texts)


def test_memo_is_bounded(monkeypatch):
    from quilt.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_UNITS", 10)
    e = Encoder(BYTE)
    texts = [f"word{i} again" for i in range(50)]
    assert e.encode(texts) == e._library(texts)
    assert len(e.pieces) < 20


ROWS = [(3, "Hello world"), (1, None), (1, ""), (2, LONG), (2, LONG), (5, "a\nb  c ünï"), (None, "nothing"), (None, None), (4, " ")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_id", F.lit("x")).withColumn("_row", F.lit(0)).repartition(3)


def test_binary_lengths():
    for n in range(1, 300):
        got = binary_lengths(n, 64)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 64 for x in got) and got == sorted(got, reverse=True)


def check_packing(rows, got):
    by_doc = {}
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    want = {}
    for x, text in rows:
        ids = np.array([*library(WORD, text), 2], "<u4")
        start = 0
        for n in binary_lengths(len(ids), 4096):
            want.setdefault(x, []).append((start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
            start += n
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_packing_odd_rows(spark):
    check_packing(ROWS, pack(frame(spark), WORD).collect())
    assert pack(frame(spark, []), WORD).count() == 0


def test_packing_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    check_packing([tuple(r) for r in docs.select("doc_id", "text").collect()], pack(docs, WORD).collect())


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 1000, 30000):
        k1, k2 = rng.integers(-(2**63), 2**63, (2, n))
        mph = S.build_mph(k1, k2)
        assert sorted(S.mph_slots(mph, k1, k2).tolist()) == list(range(n))


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_TEXT_BYTES", 100_000)
    store = S.write_store(frame(spark), BYTE)
    assert S.open_store(store.folder) == store and store.n_rows == len(ROWS)
    got = S.read_documents(spark, store, frame(spark), with_ids=True).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(((x, len(library(BYTE, t)) + 1) for x, t in ROWS), key=repr)
    by_start = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in by_start:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in by_start]
    assert order == sorted(order)
    texts = {}
    for x, t in ROWS:
        texts.setdefault(x, []).append([*library(BYTE, t), 2])
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() in texts[r["doc_id"]]


def test_store_unknown_keys_and_empty_table(spark):
    store = S.write_store(frame(spark), BYTE)
    keys = spark.createDataFrame([(i,) for i in range(100, 400)] + [(3,)], "doc_id bigint")
    assert [r["doc_id"] for r in S.read_documents(spark, store, keys).collect()] == [3]
    empty = S.write_store(frame(spark, []), BYTE)
    assert empty.shards == [] and S.read_documents(spark, empty, keys).count() == 0


def test_store_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    store = S.write_store(docs, BYTE)
    got = sorted(tuple(r) for r in S.read_documents(spark, store, docs).collect())
    want, at = [], 0
    for x, t in sorted(tuple(r) for r in docs.select("doc_id", "text").collect()):
        ids = np.array([*library(BYTE, t), 2], "<u4")
        want.append((x, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_in_a_text_are_the_librarys(path):
    """Against a tokenizer of its own, as the file gives it."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "A <|startoftext|> b\n<|endoftext|><|endoftext|>", "é 中<|endoftext|> ß", "<|ENDOFTEXT|> <|endof text|>", "plain"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == want
