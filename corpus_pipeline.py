"""From raw documents to packed training sequences in five stages.

Each stage is written as Parquet and read again as the input of the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxframe.llm import common, langid, minhash, packing, quality, suffix_dedup

NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without text, letters or a language go.

    ``lang`` keeps the source's label; where it is null the predicted language takes its place.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs, model).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies, one row of it.

    Rows that share a doc_id and their shingle set are one document; a doc_id with several texts keeps a row of each set.
    A null doc_id belongs to no group, so rows without one are kept, save those whose shingle set another such row or a
    row with a doc_id has: one row of a repeated text goes on. Rows without doc_id and without words all stay.
    """
    verdict = common.written(minhash.grouped(docs, percent=NEAR_PERCENT).select("doc_id", "set_key", "kept"), "verdict")
    rows = verdict.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    # the kept ids grow with the corpus: the same joins at every size, over one shuffle of the documents
    single = docs.join(rows.where("n = 1").hint("merge"), "doc_id", "left_semi")
    others = docs.join(rows.where("n > 1").hint("merge"), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))
    # the verdict has no texts: the sets of the few rows that it can't tell apart are made anew
    key = F.when(F.size("shingles") > 0, F.col("set_key"))
    sets = minhash.full_sets(others.select("doc_id", "text", F.struct(*docs.columns).alias("row"))).select("doc_id", key.alias("set_key"), "row")
    sets = sets.join(verdict.where("doc_id IS NOT NULL").select("set_key", F.lit(True).alias("known")).where("set_key IS NOT NULL").distinct(), "set_key", "left")
    blank = F.when(F.col("doc_id").isNull() & F.col("set_key").isNull(), F.monotonically_increasing_id())
    one = sets.where("doc_id IS NOT NULL OR known IS NULL").withColumn("blank", blank).groupBy("doc_id", "set_key", "blank").agg(F.min("row").alias("row"))
    return single.select(*docs.columns).union(one.select("row.*"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand anywhere else too; n_chars follows the text."""
    return suffix_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, match_added=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the learned model nor the tokenizer.
ORACLE_SQL = None
