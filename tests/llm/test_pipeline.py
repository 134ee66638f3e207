"""Each pipeline stage against a brute-force version on its own input."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_suffix_dedup import brute as repeats_brute
from voxframe.llm import common, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.written(stage(spark, seen[-1], SF), name))
        assert seen[-1].columns == columns and seen[-1].count() > 0
    first, identified, good, single, clean = ([r.asDict() for r in df.collect()] for df in seen)
    assert {r["doc_id"] for r in identified} == {r["doc_id"] for r in first if any(c.isalpha() for c in r["text"] or "")}
    assert all(r["lang"] for r in identified)
    verdict = {r["doc_id"]: r["kept"] for r in quality.report(seen[1]).collect()}
    assert {r["doc_id"] for r in good} == {d for d, kept in verdict.items() if kept}
    near = near_brute([(r["doc_id"], r["text"]) for r in good], corpus_pipeline.NEAR_PERCENT)
    assert {r["doc_id"] for r in single} == {d for d, _, _, kept in near if kept}
    want = {r["doc_id"]: x[3] for r, x in zip(single, repeats_brute([r["text"] for r in single], 200), strict=True)}
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert set(texts) == set(want)
    whole = [d for d, t in texts.items() if hashlib.sha256(t.encode()).hexdigest() == want[d]]
    assert len(whole) >= 0.98 * len(texts)  # a cut character is dropped from a text, not from the digest
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    fill: dict[int, int] = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
