"""Null ids and repeated rows through the pipeline's stages."""

from __future__ import annotations

import random

import corpus_pipeline
from voxframe.llm import minhash, quality


def prose(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("the and of a river stone garden winter letter captain silver harbour lantern quiet travel morning".split()) + str(rng.randrange(300)) for _ in range(90))


def test_one_row_of_each_document_goes_on(spark):
    a, b, c, d, e = map(prose, range(5))
    rows = [(1, a), (1, a), (2, b), (3, a), (None, c), (None, c), (None, d), (None, b), (4, d + " x"), (5, e), (5, c + e), (5, e), (None, None), (None, " "), (6, None), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert single.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (4, d + " x"), (5, e), (5, c + e), (6, None), (None, c), (None, d), (None, None), (None, " ")], key=str)
    assert {r["set_key"] is None for r in minhash.grouped(docs).collect()} == {True, False}


def test_no_text_is_lost_to_its_own_repeated_row(spark):
    texts = {1: prose(7), None: prose(8), 9: prose(9)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items() for _ in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, out, "")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == texts and out.count() == 3


def test_null_ids_pass_the_first_stages(spark):
    docs = spark.createDataFrame([(None, prose(3), "en", "s", 1), (1, prose(4), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in out.collect()} == {None, 1}
    verdict = {r["doc_id"]: r["kept"] for r in quality.report(docs).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs, "").collect()} == {d for d, kept in verdict.items() if kept}
