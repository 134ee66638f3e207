"""Token-id files: Parquet list columns that can be read by token, by document or by metadata alone.

A store is a folder of Parquet files in ascending document order. Columns: ``doc_id``,
``part`` (the file's place in the order), ``local_start`` (ids before it in the file),
``n_tokens`` and ``ids`` (list of int). Ids are dictionary-encoded: a vocabulary has few
distinct values, so a page holds 16-bit indexes. ``doc_id`` and ``local_start`` ascend and
are delta-encoded. Row groups are small enough for one task's memory; page indexes let
a filter on ``doc_id`` skip pages, and column pruning leaves ``ids`` unread where only
lengths matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxframe.llm import common
from voxframe.llm.chunked import ByteChunks, encoder

STORE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.page.row.count.limit": "500",
}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, match_added: bool = False) -> None:
    """Encode the whole texts of (doc_id, text) and write the store at ``path``.

    A null text is empty and gets the end id alone. Rows are dealt by ranges of doc_id, so a
    hot source or repeated rows fall where their ids do; equal doc_ids follow each other by text.
    Null doc_ids come first. An empty table gives an empty store. Other columns are ignored.
    With ``match_added`` the strings of added tokens become their ids.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ByteChunks, tokenizer_path, match_added)
        part, at = TaskContext.get().partitionId(), 0
        for block in common.blocks(batches, limit=1 << 20):
            found, after = coder.encode_many(common.texts_of(block), end_id)
            ends = np.concatenate([[0], after])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.view(np.int32)))
            yield pa.record_batch([block.column("doc_id"), pa.array(np.full(after.size, part, np.int32)), pa.array(at + ends[:-1]), pa.array(np.diff(ends).astype(np.int32)), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    common.map_arrow(dealt, encoded, STORE_SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; select what is needed, the rest stays unread."""
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids before each file. One row a file, from its lengths alone."""
    totals = read_store(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()
    base, rows = 0, []
    for row in totals:
        rows.append((row["part"], base))
        base += row["total"]
    return spark.createDataFrame(rows, "part int, base long")


def read_slice(spark: SparkSession, path: str, doc_id: int, lo: int, hi: int) -> list[int]:
    """Ids [lo, hi) of one document; only its pages are read."""
    rows = read_store(spark, path).where(F.col("doc_id") == doc_id).select(F.slice("ids", lo + 1, max(0, hi - lo)).alias("ids")).collect()
    return rows[0]["ids"] if rows else []


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and ids_crc32, all from the files."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            ends = ids.offsets.to_numpy()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    stored = read_store(spark, path).select("doc_id", "part", "local_start", "ids")
    rows = common.map_arrow(stored, summed, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
