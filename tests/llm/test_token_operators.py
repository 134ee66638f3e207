"""Token stores, packing and piece encoding against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxframe.llm import packing, piece_encode, token_store
from voxframe.llm.chunked import ByteChunks, WordChunks, encoder

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "   ", "\n\n \t", "a" * 3000, " lead", "trail ", "a  b   c", "don't I'll we've", "<|endoftext|>", "<|startoftext|> x", "é é ß İ ı ǅ", "日本語テキスト 한국어", "🙂🙂 emoji 👩‍👩", "x y z　w​q", "12345 6.78 1e9", "a,b;c:d!e?", "▁ ▁▁x", "\x00\x01\x7f", "Ünïcödé WORDS Mixed", "﻿bom", "tab\tsep\rcr\x0bvt\x0cff\x1cfs\x85nel", "a_b-c/d\\e", "ﬁ ﬂ Ⅷ ²", "#hash @at $1,000.00 50%", "'s 't x's'", "퟿ ok"]


def texts():
    rng = random.Random(5)
    pool = [c for t in ODD if t for c in t] + list(" " * 30) + list("etaoinshrdlu" * 4)
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    import pyarrow.parquet as pq

    return ODD + made + pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column("text").to_pylist()


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("kind", "name"), [(ByteChunks, "byte_bpe_50k.json"), (WordChunks, "word_bpe_49k.json")])
def test_chunked_encoding_equals_the_library(kind, name):
    own, lib = encoder(kind, public_tokenizers.path(name)), library(name)
    for t in texts():
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == want, repr(t)


def test_store_round_trip(spark, tmp_path):
    rows = [(100 - k, t) for k, t in enumerate(ODD)] + [(7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumnRenamed("text", "text")
    path = f"file://{tmp_path}/store"
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.digests(spark, path).collect())
    lib, at, want = library("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    ids = lib.encode("don't I'll we've", add_special_tokens=False).ids
    assert token_store.read_slice(spark, path, 100 - ODD.index("don't I'll we've"), 1, 3) == ids[1:3]


def test_store_of_an_empty_table(spark, tmp_path):
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.digests(spark, f"file://{tmp_path}/e").collect() == []


def test_packing_tiles_every_document(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (500, "long word " * 6000), (501, None), (501, None)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    lib, by_doc, by_bin = library("word_bpe_49k.json"), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in [*enumerate(ODD), (500, "long word " * 6000)]:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert len(by_doc[501]) == 2
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_bin) <= sum(r["length"] for r in rows) // 4096 + 2
    assert packing.pack(packing.pieces(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(1)
    demands = np.stack([rng.integers(1, 50, 400), np.ones(400), rng.integers(1, 900, 400)], axis=1).astype(float)
    limits = np.array([100.0, 5, 2000])
    bins, n = packing.best_fit(demands[np.argsort(-demands[:, 0])], limits, rule=rule)
    for k in range(3):
        assert np.bincount(bins, demands[np.argsort(-demands[:, 0])][:, k]).max() <= limits[k]
    assert bins.max() + 1 == n


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own, all_texts = sentencepiece.SentencePieceProcessor(model_file=path), piece_encode.encoder(path), [t or "" for t in texts()]
    for t, ids in zip(all_texts, own.encode_many(all_texts), strict=True):
        assert ids.tolist() == lib.encode(t), repr(t)
    docs = spark.createDataFrame([*enumerate(ODD), (3, "again"), (3, "again")], "doc_id long, text string")
    got = sorted(tuple(r) for r in piece_encode.digests(docs, path).collect())
    want = []
    for doc_id, t in [*enumerate(ODD), (3, "again"), (3, "again")]:
        ids = lib.encode(t or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert [tuple(r) for r in piece_encode.encode(docs.where("doc_id = 1"), path).collect()] == [(1, [], "")]
