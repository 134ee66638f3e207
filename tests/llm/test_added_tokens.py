"""Added tokens in texts: the registered queries against the library as it loads."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_token_operators import texts
from voxframe.llm import queries
from voxframe.llm.chunked import ByteChunks, WordChunks, encoder

MARKED = ["end <|endoftext|> of", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|startoftext|>b", " <|startoftext|>  <|ENDOFTEXT|> <|endoftext|", "word<|endoftext|>'s\n<|endoftext|>\t"]


@pytest.mark.parametrize(("kind", "name"), [(ByteChunks, "byte_bpe_50k.json"), (WordChunks, "word_bpe_49k.json")])
def test_encoding_equals_the_library_as_it_loads(kind, name):
    path = public_tokenizers.path(name)
    own, lib = encoder(kind, path, match_added=True), Tokenizer.from_file(path)
    made = [t or "" for t in texts()]
    for t in [*MARKED, *made, *[f"{a}<|endoftext|>{b}" for a, b in zip(made, made[1:])]]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_queries_match_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(MARKED)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    byte, word = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    crc = lambda lib, t, end: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes())
    stored = {r["doc_id"]: r["ids_crc32"] for r in queries.op3_token_store(spark, str(tmp_path)).collect()}
    assert stored == {k: crc(byte, t, 2) for k, t in enumerate(MARKED)}
    want = {k: crc(word, t, 1) for k, t in enumerate(MARKED)}
    for packed in (queries.op9_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: r["ids_crc32"] for r in packed.collect()} == want
