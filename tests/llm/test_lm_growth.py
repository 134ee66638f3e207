"""A rare pair has its arc in a corpus of any size."""

from __future__ import annotations

import math
import zlib

import pytest

from voxframe.llm import lm_score


def test_windows_of_tokens_change_nothing(monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 7}" for j in range(k % 40))) for k in range(80)]
    monkeypatch.setattr(lm_score, "TOKENS", 5)
    grams = lm_score.Grams.of([t for _, t in rows])
    totals = lm_score.np.arange(grams.keys.size) % 5
    grams = grams.with_triples(totals)
    asked = lm_score.asked_of(grams, totals)
    args = (totals, lm_score.np.arange(grams.triples.size) % 4, asked, lm_score.np.ones((asked.size, 3), int), 500)
    small = lm_score.token_scores(grams, *args)
    monkeypatch.setattr(lm_score, "TOKENS", 1 << 17)
    for a, b in zip(small, lm_score.token_scores(grams, *args), strict=True):
        assert a.tolist() == b.tolist()


def test_a_rare_pair_has_an_arc_at_every_size(spark):
    train = [k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 7 != 2]
    for documents in (5, 250):
        rows = [(k, " ".join(f"w{(k + j) % 50}" for j in range(200))) for k in train[:documents]]
        rows += [(k, "rare pair") for k in train[documents : documents + 3]]
        tokens, words = documents * 201 + 9, 53
        got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        row = got[train[documents]]
        assert (row["train_tokens"], row["n_known"]) == (tokens, 3)
        assert row["score"] == pytest.approx(math.log10(4 / (tokens + words + 1)) + 2 * math.log10(2.5 / 3))
