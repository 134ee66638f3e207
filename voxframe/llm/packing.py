"""Best-fit packing of tokenized documents into fixed-length training sequences.

Vector best-fit: a bin has a residual for each resource (tokens, documents, attention
cost), a piece a demand for each. Pieces are taken in descending length; among the bins
that hold a piece under every constraint, the one with the smallest weighted residual
norm after placing it (or the largest weighted dot-product of demand and residual) gets it.
Pieces are dealt at random to shards of some ten thousand, each packed on its own: a shard wastes
at most its last few bins, so the count stays next to that of a single packer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxframe.llm import common
from voxframe.llm.chunked import WordChunks, encoder

CAPACITY = 4096
#: Documents of a sequence at most; attention is computed in square tiles of so many tokens.
MAX_DOCUMENTS, TILE = 512, 128
SHARD_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, match_added: bool = False) -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A null text is empty; every document ends with ``end_id``, so each has a piece. Only
    documents longer than ``capacity`` are cut. Repeated rows are packed once each. An empty table
    has no pieces. With ``match_added`` the strings of added tokens become their ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(WordChunks, tokenizer_path, match_added)
        for block in common.blocks(batches, limit=1 << 20):
            ids, ends = coder.encode_many(common.texts_of(block), end_id)
            data, sizes = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(ends, prepend=0)
            parts = -(-sizes // capacity)
            of = np.repeat(np.arange(sizes.size), parts)
            piece = np.arange(of.size) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = (ends - sizes)[of] + piece * capacity
            stop = np.minimum(begin + capacity, ends[of])
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.record_batch([block.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(stop - begin), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECE_SCHEMA)


def best_fit(
    demands: np.ndarray,
    capacities: np.ndarray,
    weights: np.ndarray | None = None,
    rule: str = "norm",
) -> tuple[np.ndarray, int]:
    """The bin of each row of ``demands`` (items x resources), rows taken in the given order.

    Every item must fit an empty bin. Ties go to the bin opened first. Bins in the same state
    are interchangeable, so one entry stands for a stack of them; a full bin leaves the table.
    """
    weights = np.ones(capacities.size) if weights is None else weights
    scaled, share = demands / capacities, weights / capacities
    least = np.minimum.accumulate(demands[::-1], axis=0)[::-1]
    residual = np.empty((256, capacities.size))
    names = np.empty(256, np.int64)
    live, opened, bins = 0, 0, np.empty(len(demands), np.int64)
    for i, need in enumerate(demands):
        at = -1
        if live:
            left = residual[:live] - need
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if fits.size:
                if rule == "dot":
                    at = fits[np.argmax((residual[fits] * (scaled[i] * share)).sum(axis=1))]
                else:
                    at = fits[np.argmin((np.square(left[fits] / capacities) * weights).sum(axis=1))]
        if at < 0:
            if live == len(names):
                residual, names = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([names, np.empty_like(names)])
            residual[live], names[live] = capacities, opened
            at, live, opened = live, live + 1, opened + 1
        residual[at] -= need
        bins[i] = names[at]
        if (residual[at] < least[min(i + 1, len(least) - 1)]).any():
            live -= 1
            residual[at], names[at] = residual[live], names[live]
    return bins, opened


def attention_cost(length: np.ndarray, tile: int) -> np.ndarray:
    """What a kernel computes for a piece of its own attention: whole tiles of the square of its length."""
    return np.square(np.ceil(length / tile) * tile)


def pack(cut: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, attention: float | None = None, rule: str = "norm", tile: int = TILE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Assign pieces (doc_id, piece, start, length, ...) to sequences: adds sequence_id and offset.

    A sequence holds at most ``capacity`` tokens, ``max_documents`` pieces and the attention cost ``attention``, by
    default that of one piece of ``capacity`` tokens, so that every piece fits; then more than (capacity / tile)^2 very short
    pieces exceed it. Offsets are gapless from 0. Pieces are written when this is called.
    """
    tile = min(tile, capacity)
    cost = max(attention or 0.0, float(attention_cost(np.array(capacity), tile)))
    cut = common.written(cut, "pieces")
    shards = max(1, math.ceil(cut.count() / shard_pieces))
    kept = [f for f in cut.schema.fields if f.name not in ("shard", "sequence_id", "offset")]
    schema = cut.select(*[f.name for f in kept]).schema.add("sequence_id", "long").add("offset", "long")

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        length = table.column("length").to_numpy().astype(np.float64)
        bins, _ = best_fit(np.stack([length, np.ones_like(length), attention_cost(length, tile)], axis=1), np.array([capacity, max_documents, cost], float), np.array([1.0, 0.05, 0.05]), rule)
        order = np.argsort(bins, kind="stable")
        size = length[order].astype(np.int64)
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        return table.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 32) + bins)).append_column("offset", pa.array(offset))

    dealt = cut.select(*[f.name for f in kept], F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(packed, schema)
