"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import common, html_extract, langid, lm_score, media, minhash, packing, piece_encode, quality, suffix_dedup, token_store


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(common.documents(spark, sf_dir, "doc_id", "text", "lang"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.work_path(spark, "tokens")
    token_store.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, match_added=True)
    return token_store.digests(spark, path)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir), percent=85)


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(common.written(media.media_table(common.documents(spark, sf_dir)), "media"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(common.documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(common.documents(spark, sf_dir))


def op8_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode.digests(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, match_added=True))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_token_store": op3_token_store,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_jpeg_media": op5_jpeg_media,
        "op6_lm_score": op6_lm_score,
        "op7_quality_rules": op7_quality_rules,
        "op8_piece_encode": op8_piece_encode,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality.ORACLE}
