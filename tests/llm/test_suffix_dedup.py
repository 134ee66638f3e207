"""Removal of repeated strings against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from voxframe.llm import suffix_dedup


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    words = ["ab", "c", "dé", "fgh", "aa", "b b", "ß", "\n"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [make(30) for _ in range(4)]
    texts: list[str | None] = [None, "", "short", "x" * 500, "xy" * 150]
    for _ in range(n):
        parts = [make(rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        texts.append(" ".join(parts))
    copied = [t for t in texts if t and rng.random() < 0.2]
    near = [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in copied]
    return texts + copied + copied[:2] + near


def result(df) -> dict[int, tuple]:
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "length"), [(1, 200), (2, 60), (3, 24)])
def test_equals_brute_force(spark, seed, length):
    texts = corpus(seed, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert result(suffix_dedup.dedup(docs, length)) == dict(enumerate(brute(texts, length)))


def test_crowded_anchors_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_CONTEXTS", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "MERGE_ROWS", 100)
    texts = corpus(7, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(suffix_dedup.dedup(docs, 60)) == dict(enumerate(brute(texts, 60)))


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a" * 300, "s", 5, "u"), (1, "a" * 300, None, 6, "u"), (None, None, "t", 7, None)], "doc_id long, text string, source string, n_bytes int, uid string")
    rows = suffix_dedup.dedup(docs).orderBy("source").collect()
    assert rows[0].asDict() | {"kept_sha256": ""} == {"doc_id": 1, "text": "", "source": None, "uid": "u", "n_bytes": 300, "n_removed": 300, "n_spans": 1, "kept_sha256": ""}
    assert rows[2]["text"] is None and rows[2]["n_bytes"] == 0


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_cut_character_is_dropped_from_the_text(spark):
    # the repeated bytes end within a character of two bytes: é and è share their first byte
    docs = spark.createDataFrame([(1, "k" * 199 + "é tail"), (2, "k" * 199 + "è rest")], "doc_id long, text string")
    assert sorted(r["text"] for r in suffix_dedup.dedup(docs).collect()) == [" rest", " tail"]


def test_suffix_array_and_prefixes_by_sorting():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    begin = np.array([0, 100, 180])
    stop = np.repeat([100, 180, 300], [100, 80, 120])
    order, _ = suffix_dedup.suffix_array(text, stop, 150)
    suffixes = [text[k : stop[k]].tobytes() for k in order]
    assert suffixes == sorted(suffixes)
    prefix = suffix_dedup.common_prefixes(text, begin, stop, order, 20)
    for k in range(1, 300):
        a, b = suffixes[k - 1], suffixes[k]
        expected = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
        assert prefix[k] == min(20, expected)
