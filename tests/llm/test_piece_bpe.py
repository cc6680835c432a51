"""Encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from caselake.llm import piece_bpe as P
from caselake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def own():
    return P.model()


def encoded(own, texts):
    flat, counts = own.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def samples(own):
    rng = random.Random(1)
    signs = "aetion shrd\n\t  ▁▁.,01é日本ゼ벨梦😀\0�À<s>The"
    out = ["", " ", "a", "  a", "<s>", "▁", "\n", "hello  world", " " * 300 + "x" + " " * 1000, "ab" * 3000, "Theтест " * 50, "😀" * 10]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 100))) for _ in range(500)]
    return out + ["".join(rng.choice(own.pieces) for _ in range(4)) for _ in range(8000)]


def test_ids_equal_the_librarys(own, library):
    texts = samples(own)
    assert encoded(own, texts) == library.encode(texts)


@pytest.mark.parametrize("span", [1, 7, 100])
def test_spans_do_not_show(own, library, monkeypatch, span):
    monkeypatch.setattr(P, "SPAN", span)
    texts = samples(own)[:300]
    assert encoded(own, texts) == library.encode(texts)


def test_heap_and_rounds_agree(own, library, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 2)
    monkeypatch.setattr(P, "LONG", 3)
    texts = samples(own)[:600]
    assert encoded(own, texts) == library.encode(texts)


@pytest.mark.parametrize("sign", [" ", "a", "\n", "=", "語", "😀"])
def test_very_long_runs(own, library, sign):
    text = sign * 500_000
    assert encoded(own, [text, "x"]) == [library.encode(text), library.encode("x")]


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(3)
    rows = [[rng.choice([rng.randint(0, len(own.pieces) - 1), rng.randint(0, 3), rng.randint(3, 258), rng.randint(190, 258)]) for _ in range(rng.randint(0, 30))] for _ in range(6000)]
    flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
    assert own.decode(flat, np.array([len(r) for r in rows])) == library.decode(rows)
    with pytest.raises(IndexError):
        own.decode(np.array([len(own.pieces)]), np.array([1]))


def test_columns_and_edge_rows(spark, library):
    rows = [(1, "The cat.", 1), (1, "The cat.", 1), (2, None, 2), (3, "", 3), (None, " \n", 4), (5, "\0é" * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded long")
    tokens = P.encode_documents(docs)
    got = tokens.select("doc_id", "text", "ids").collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d), library.encode(t or "")) for d, t, _ in rows)
    back = P.decode_documents(tokens, text_col="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    with pytest.raises(ValueError):
        P.decode_documents(tokens)
    with pytest.raises(ValueError):
        P.encode_documents(tokens)
    assert P.token_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_its_table(spark, library):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_piece_tokens"](spark, d).collect()} == want
