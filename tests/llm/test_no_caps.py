"""Hot rows, long blocks and binding capacities: nothing is cut off and nothing is squeezed out."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_token_operators import ODD, library, texts
from voxframe.llm import common, html_extract, langid, packing
from voxframe.llm.chunked import ByteChunks, WordChunks, encoder


def test_a_hot_text_squeezes_no_language_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    known = {r["lang"] for r in docs.where("lang IS NOT NULL").distinct().collect()}
    hot = docs.where("lang = 'de'").limit(1).crossJoin(spark.range(20000)).select("text", "lang")
    model = langid.fit(hot.union(docs), sample_texts=20)
    assert set(model.languages) == known
    text = docs.where("lang = 'en'").first()["text"]
    assert model.predict(text)[0] == "en"


def test_every_word_of_a_block_counts():
    model = html_extract.Labeller()
    path = (1, 2)
    for n in (10, 100, 600, 3000):
        words = [f"w{k}" for k in range(n)]
        x = model.inputs([(" ".join(words), path, 0), (" ".join([*words[:-1], "other"]), path, 0)])[0]
        lo, hi = html_extract.PATH_DIM, html_extract.PATH_DIM + html_extract.WORD_DIM
        want = np.mean([model.w["word"][html_extract.zlib.crc32(w.encode()) % html_extract.WORD_SLOTS] for w in words], axis=0)
        assert x[0, lo:hi] == pytest.approx(want) and not np.allclose(x[0, lo:hi], x[1, lo:hi], atol=1e-9)


def plain_lstm(model, x, d):
    """One page, one step at a time, one gate at a time."""
    n, h, c, out = html_extract.HIDDEN, None, None, {}
    h = c = np.zeros(n)
    for t in range(len(x)) if d == "f" else reversed(range(len(x))):
        z = x[t] @ model.w[f"x{d}"] + h @ model.w[f"h{d}"] + model.w[f"c{d}"]
        gate = [1 / (1 + np.exp(-z[k * n : (k + 1) * n])) for k in range(3)]
        c = gate[1] * c + gate[0] * np.tanh(z[3 * n :])
        h = gate[2] * np.tanh(c)
        out[t] = h
    return np.array([out[t] for t in range(len(x))])


def test_labeller_equals_a_plain_loop():
    rng = np.random.default_rng(8)
    pages = [html_extract.blocks_of(html_extract.made_up_page(rng)[0]) for _ in range(6)]
    model = html_extract.trained()
    for page, got in zip(pages, model.scores(pages), strict=True):
        x = model.inputs(page)[0]
        both = np.concatenate([plain_lstm(model, x, "f"), plain_lstm(model, x, "b"), x], axis=1)
        assert got == pytest.approx(both @ model.w["out"][:, 0] + model.w["bias"][0])


@pytest.mark.parametrize(("kind", "name"), [(ByteChunks, "byte_bpe_50k.json"), (WordChunks, "word_bpe_49k.json")])
def test_many_texts_at_once_equal_the_library(kind, name, monkeypatch):
    own, lib, made = encoder(kind, public_tokenizers.path(name)), library(name), [t or "" for t in texts()]
    for window, pool in ((1 << 16, 1 << 22), (37, 5000)):
        monkeypatch.setattr("voxframe.llm.chunked.WINDOW", window)
        monkeypatch.setattr("voxframe.llm.chunked.POOL_IDS", pool)
        ids, ends = own.encode_many(made, end_id=9)
        at = 0
        for t, end in zip(made, ends.tolist(), strict=True):
            assert ids[at:end].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 9], repr(t)
            at = end
    assert own.encode_many([])[0].size == 0 and own.encode_many([""])[1].tolist() == [0] and len(ODD) < len(made)


def plain_best_fit(demands, capacities, weights):
    """Every bin in a list, every bin tried for every item."""
    left, out = [], []
    for need in demands:
        able = [k for k, r in enumerate(left) if (r >= need).all()]
        if able:
            k = min(able, key=lambda k: (float((((left[k] - need) / capacities) ** 2 * weights).sum()), k))
        else:
            k = len(left)
            left.append(capacities.astype(float))
        left[k] = left[k] - need
        out.append(k)
    return out, len(left)


def test_best_fit_uses_as_many_bins_as_a_plain_loop():
    rng = np.random.default_rng(6)
    weights = np.array([1.0, 0.05, 0.05])
    for size in (60, 700):
        length = np.sort(rng.integers(1, 4097, size))[::-1].astype(float)
        demands = np.stack([length, np.ones(size), packing.attention_cost(length, 128)], axis=1)
        for capacities in (np.array([4096, 3, 4096.0**2]), np.array([4096, 512, 4096.0**2])):
            want, bins = plain_best_fit(demands, capacities, weights)
            got, n = packing.best_fit(demands, capacities, weights)
            assert n == bins
            for k in range(3):
                assert np.bincount(got, demands[:, k]).max() <= capacities[k]
            assert sorted(np.bincount(got, length)) == sorted(np.bincount(want, length))


def test_documents_and_attention_bind(spark):
    cut = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "id AS ids_crc32")
    for extra, most in (({"max_documents": 4096, "attention": 1e12}, 3000), ({"max_documents": 4096}, 1024), ({}, 512), ({"max_documents": 100}, 100)):
        fill = {}
        for r in packing.pack(cut, **extra).collect():
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + 1
        assert max(fill.values()) == most and len(fill) == -(-3000 // most)


def test_many_shards_fill_as_well(spark):
    cut = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + pmod(xxhash64(id), 2000) AS length", "id AS ids_crc32", "'x' AS shard", "'y' AS offset")
    tokens = cut.agg({"length": "sum"}).first()[0]
    rows = packing.pack(cut, shard_pieces=400)
    n = rows.select("sequence_id").distinct().count()
    assert n <= 1.02 * tokens / 4096 + 11 and rows.count() == 4000 and "shard" not in rows.columns


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.work_path(Cluster, "x")


def test_intermediate_rows_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_MADE", [])
    monkeypatch.setattr(common, "_TABLES", [])
    monkeypatch.setattr(common, "work_path", lambda spark, name: common._MADE.append(f"file://{tmp_path}/{name}") or common._MADE[-1])
    common.written(spark.range(5), "a")
    common.bucketed(spark.range(5), "kept_b", "id", 2)
    assert len(list(tmp_path.glob("[a-z]*"))) == 2
    common.clear(spark)
    assert not list(tmp_path.glob("[a-z]*")) and "kept_b" not in [t.name for t in spark.catalog.listTables()]
