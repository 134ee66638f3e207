"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters the shingles over 2^32 places, a second one, circularly shifted by k, gives
coordinate k of the signature. Documents with equal shingle sets form a class, and classes are compared through
their representatives. Representatives that share a band are candidates; candidates connected
through bands are verified together, on their full sets, in blocks of bounded size.

With bands of 4 coordinates and 24 bands, two sets at a similarity of 0.85 miss every band with a
probability of about 2e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voxframe.llm import common
from voxframe.llm.components import components
from voxframe.llm.shingles import mixed, shingle_set

ROWS, BANDS = 4, 24
#: A verification block holds about so many members and shingles of either side.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 19


def scattered(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ np.uint32(seed)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least place under the second permutation shifted by k."""
    first = scattered((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32), 0x3C6EF372)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for lo in range(0, first.size, 512):
        np.minimum(out, scattered(first[lo : lo + 512] + shifts, 0x1B873593).min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of a signature, the band's number included."""
    keys = np.arange(values.size // rows, dtype=np.uint64) + np.uint64(1)
    for part in values.reshape(-1, rows).T:
        keys = mixed(keys ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """A cryptographic digest of a whole set, ascending: sets with one digest are taken to be equal."""
    return hashlib.blake2b(np.ascontiguousarray(shingles, "<u8"), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key and bands of each document; without words both are null."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            n, keys, bands = [], [], []
            for text in common.texts_of(block):
                own = shingle_set(text.encode(), width)
                n.append(own.size)
                keys.append(set_key(own) if own.size else None)
                bands.append(band_keys(signature(own)) if own.size else None)
            yield pa.record_batch([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), signed, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """All columns of ``docs`` but text, with set_key and the whole shingle set."""
    kept = [c for c in docs.columns if c != "text"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            sets = [shingle_set(t.encode(), width) for t in common.texts_of(block)]
            yield pa.record_batch([*[block.column(c) for c in kept], pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=[*kept, "set_key", "shingles"])

    schema = docs.select(*kept).schema.add("set_key", "binary").add("shingles", T.ArrayType(T.LongType()))
    return common.map_arrow(docs, shingled, schema)


class Forest:
    """Union-find over members of a block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_within(values: np.ndarray, ends: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets values[ends[i]:ends[i+1]].

    Members of one ``side`` (0 or 1) are compared with the other's, or all with all where there is one side.
    A shingle that one set alone has is in no intersection; a set with too few of the others has no link.
    """
    _, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    size = np.diff(ends)
    owner = np.repeat(np.arange(size.size), size)
    shared = counts[codes] > 1
    able = np.bincount(owner[shared], minlength=size.size) * 100 >= percent * size
    use = shared & able[owner]
    codes, owner = codes[use], owner[use]
    members = np.flatnonzero(able)
    if members.size < 2:
        return []
    begin = np.searchsorted(owner, members)
    stop = np.append(begin[1:], owner.size)
    mark = np.zeros(counts.size, bool)
    forest, found = Forest(size.size), []
    two = side.min() != side.max()
    for k, i in enumerate(members[:-1].tolist()):
        lo = stop[k]
        if lo >= owner.size:
            break
        own = codes[begin[k] : lo]
        mark[own] = True
        both = np.add.reduceat(mark[codes[lo:]].astype(np.int64), begin[k + 1 :] - lo)
        mark[own] = False
        rest = members[k + 1 :]
        linked = both * 100 >= percent * (size[i] + size[rest] - both)
        if two:
            linked &= side[rest] != side[i]
        for j in rest[linked].tolist():
            if forest.join(i, j):
                found.append((i, j))
    return found


def against_hubs(candidates: DataFrame, percent: int) -> DataFrame:
    """(cluster, doc_id, set_key, near, far) of each candidate against one set of its cluster's least doc_id.

    near: the two are linked; far: their Jaccard distance.
    """
    hubs = candidates.where("doc_id = cluster").groupBy("cluster").agg(F.min_by("shingles", "set_key").alias("hub"))
    shared = F.size(F.array_intersect("shingles", "hub"))
    both = candidates.join(hubs, "cluster").select("cluster", "doc_id", "set_key", shared.alias("i"), (F.size("shingles") + F.size("hub")).alias("n"))
    return both.select("cluster", "doc_id", "set_key", (F.col("i") * 100 >= percent * (F.col("n") - F.col("i"))).alias("near"), (1 - F.col("i") / (F.col("n") - F.col("i"))).alias("far"))


def verified(candidates: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among candidates (doc_id, cluster, set_key, shingles) of one cluster that join the same documents as all links do.

    Each is compared with its cluster's hub first. Two that are linked to the hub need no comparison, and,
    Jaccard distances being a metric, one at a distance x from the hub can be linked only to those between x - reach and
    x + reach. So a group of near copies of one text, however large, costs one comparison a member. What is left is
    compared in blocks: a cluster beyond a block's size is dealt by a hash of doc_id to parts, and each pair of parts makes a block.
    """
    measured = common.written(against_hubs(candidates, percent), "hub-distances")
    reach = 1 - percent / 100 + 1e-9
    least = measured.where("NOT near").groupBy("cluster").agg(F.min("far").alias("least"))
    open_ = measured.join(least, "cluster").where(~F.col("near") | (F.col("far") >= F.col("least") - reach)).select("cluster", "doc_id", "set_key")
    candidates = candidates.join(open_, ["cluster", "doc_id", "set_key"]).select("cluster", "doc_id", "shingles")
    sized = candidates.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("s"))
    parts = sized.where("m > 1").select("cluster", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = candidates.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pairs = dealt.select("cluster", "doc_id", "shingles", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = pairs.select("cluster", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("second"), "doc_id", "shingles")

    def linked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        ids = table.column("doc_id").to_numpy()
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.asarray(lists.value_lengths())
        found = links_within(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), table.column("second").to_numpy().astype(int), percent)
        a, b = (np.asarray(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        return pa.table({"a": ids[a] if len(a) else np.zeros(0, np.int64), "b": ids[b] if len(b) else np.zeros(0, np.int64)})

    return blocks.groupBy("cluster", "lo", "hi").applyInArrow(linked, "a long, b long").union(measured.where("near").select("doc_id", "cluster"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. A text
    of fewer than ``width`` words is one shingle; null texts and texts without words have no set, are linked with nothing and kept.
    Of repeated rows all get their doc_id's component. A null doc_id is its own component, null, and kept.
    An empty table gives an empty one; other columns are ignored.
    """
    return grouped(docs, percent, width).drop("set_key")


def grouped(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """``near_duplicates`` with the set_key of each row, null without a set."""
    signed = common.written(signatures(docs, width), "signatures")
    classes = common.written(signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = banded.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = common.written(components(edges), "clusters")
    wanted = clusters.join(classes.select(F.col("rep").alias("node"), "set_key"), "node").select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"), F.col("set_key").alias("wanted"))
    # candidates grow with the corpus: the same join at every size
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("merge"), "doc_id")
    sets = full_sets(texts, width).where("set_key = wanted").select("doc_id", "cluster", "set_key", "shingles")
    links = verified(common.written(sets.dropDuplicates(["doc_id", "cluster", "set_key"]), "sets"), percent)
    # a doc_id with several texts joins their classes
    several = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(classes.select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.union(several))
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("root", "doc_id"))
        .select("doc_id", "n_shingles", "set_key", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
