"""Removal of long repeated substrings by suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.

Equal texts are one text. In every ``length``-byte string one gram of somewhat over half the length is its
anchor: the place of the least hash of much shorter grams, modulo the number of places that an anchor can
take. So two equal strings hold equal anchors at equal places, and only one byte in fifty starts an anchor. A string can only repeat where
its anchor does; the context of such an anchor, all strings whose anchor it is, goes to the shard of the anchor.
Equal contexts repeat as a whole. Each shard sorts the suffixes of its distinct contexts
(Larsson-Sadakane refinement), takes common prefixes (Kasai) and so finds strings that occur twice. An
anchor with very many contexts is dealt to several shards; what one of them leaves open is
looked up by binary search among the sorted digests of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from voxframe.llm import common
from voxframe.llm.shingles import mixed

LENGTH = 200
#: Bytes of contexts in a shard, contexts of one anchor in a shard, digests in a merge bucket.
SHARD_BYTES, ANCHOR_CONTEXTS, MERGE_ROWS = 3 << 17, 2000, 200_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or held[0].size < n:
        size = max(n, 1 << 16)
        odd = _ODD[base]
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, odd, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]))
        _POWERS[base] = held = (up, down)
    return held


def gram_hashes(raw: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """A 64-bit hash of each k-byte substring."""
    n = raw.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(raw.size + 1, base)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: raw.size])])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def sliding(values: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each window of ``w`` values."""
    n = values.size - w + 1
    fill = np.iinfo(values.dtype).max if least else 0
    op = np.minimum if least else np.maximum
    blocks = np.append(values, np.full(-values.size % w, fill, values.dtype)).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def gram_sizes(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and of the short grams that choose it, for strings of ``length`` bytes."""
    gram = max(1, length * 29 // 50)
    least = min(8, gram)
    return gram, least + (gram - least) % (length - gram + 1)


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lo, hi): the anchors of all ``length``-byte strings, each with the range of starts of its strings.

    The first of equal short hashes counts, so an anchor's place in its string depends on the string alone.
    """
    n = raw.size - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, short = gram_sizes(length)
    hashes = gram_hashes(raw, short)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(hashes.size, dtype=np.uint64)
    least = sliding(keys, length - short + 1, True) & np.uint64(0xFFFFFFFF)
    start = np.arange(n)
    chosen = start + (least.astype(np.int64) - start) % (length - gram + 1)
    lo = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[lo], lo, np.append(lo[1:], n)


def suffix_array(text: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of the suffixes of ``text``, each cut at ``stop[i]``, sorted to ``depth`` bytes at least.

    Larsson-Sadakane: suffixes are grouped by their first 7 bytes; then only groups of more than one are
    sorted, by the ranks h further on, and h doubles.
    """
    n = text.size
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(place + k < stop, padded[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    h = 7
    while h < depth:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not open_.size:
            break
        members = order[open_]
        on = members + h
        second = np.where(on < stop[members], rank[np.minimum(on, n - 1)] + 1, 0)
        group = rank[members]
        by = np.argsort(group * (n + 1) + second, kind="stable")
        members, group, second = members[by], group[by], second[by]
        order[open_] = members
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        new[open_] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, open_, 0))
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, begin: np.ndarray, stop_of: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Kasai: the common prefix, at most ``most``, of each suffix in order with the one before it.

    A step to the next suffix of a context loses one byte at most, so comparison goes on where it ended. The
    contexts, which start at ``begin``, advance side by side.
    """
    n = text.size
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    prefix = np.zeros(n, np.int64)
    at, end, h = begin.copy(), stop_of[begin], np.zeros(begin.size, np.int64)
    while at.size:
        other = before[at]
        h = np.maximum(h - 1, 0)
        h[other < 0] = 0
        limit = np.minimum(np.minimum(end - at, np.where(other < 0, 0, stop_of[other] - other)), most)
        h = np.minimum(h, limit)
        live = np.flatnonzero(h < limit)
        while live.size:
            same = text[at[live] + h[live]] == text[other[live] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < limit[live]]
        prefix[at] = h
        at = at + 1
        going = at < end
        at, end, h = at[going], end[going], h[going]
    return prefix[order]


def repeated_starts(text: np.ndarray, begin: np.ndarray, stop: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(classes, repeats): per byte the class of the ``length``-byte string that starts there (-1: none fits), and per byte whether it occurs at two places.

    ``place`` names the place of each byte in its document: contexts that overlap hold the same places.
    """
    # sorted to the end, equal suffixes by place: else a carried prefix could exceed that with the suffix before
    order, _ = suffix_array(text, stop, int((stop[begin] - begin).max()))
    prefix = common_prefixes(text, begin, stop, order, length)
    classes = np.cumsum(prefix < length) - 1
    fits = stop[order] - order >= length
    where, kinds = order[fits], classes[fits]
    low, high = np.full(classes[-1] + 1, np.iinfo(np.int64).max), np.full(classes[-1] + 1, -1, np.int64)
    np.minimum.at(low, kinds, place[where])
    np.maximum.at(high, kinds, place[where])
    of, twice = np.full(text.size, -1, np.int64), np.zeros(text.size, bool)
    of[where] = kinds
    twice[where] = (low != high)[kinds]
    return of, twice


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(fp, whole, uid, lo, hi) of each anchor; whole: a hash of its context and its place there; lo, hi: the range of starts."""
    gram, _ = gram_sizes(length)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=2 << 20):
            uid, fp, whole, ranges = [], [], [], []
            for name, text in zip(block.column("uid").to_pylist(), common.texts_of(block), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                places, first, last = anchors(raw, length)
                if not places.size:
                    continue
                up, down = _powers(raw.size + 1, 0)
                sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: raw.size])])
                hashes = mixed((sums[places + gram] - sums[places]) * down[places])
                lo, hi = first, last + (length - 1)
                context = mixed((sums[hi] - sums[lo]) * down[lo]) ^ mixed((places - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
                uid += [name] * places.size
                fp.append(hashes)
                whole.append(mixed(context))
                ranges.append((first, last))
            join = lambda x, t: np.concatenate(x).view(t) if x else np.zeros(0, t)
            yield pa.record_batch([pa.array(join(fp, np.int64)), pa.array(join(whole, np.int64)), pa.array(uid, pa.binary()), *[pa.array(join([r[k] for r in ranges], np.int64)) for k in (0, 1)]], names=["fp", "whole", "uid", "lo", "hi"])

    return common.map_arrow(texts, found, "fp long, whole long, uid binary, lo long, hi long")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The context bytes of wanted anchors (uid, fp, whole, lo, hi, multi, parts)."""
    listed = wanted.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "fp", "multi", "parts", "whole")).alias("list"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=1 << 20):
            out: list[tuple] = []
            for name, text, items in zip(block.column("uid").to_pylist(), common.texts_of(block), block.column("list").to_pylist(), strict=True):
                raw = text.encode()
                for x in items:
                    out.append((x["fp"], x["whole"], name, x["lo"], raw[x["lo"] : x["hi"] - 1 + length], x["multi"], x["parts"]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int32())
            for k in range(0, len(out), 20_000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000], strict=True), kinds, strict=True)], names=["fp", "whole", "uid", "lo", "context", "multi", "parts"])

    return common.map_arrow(texts.join(listed, "uid"), cut, "fp long, whole long, uid binary, lo long, context binary, multi boolean, parts int")


def _shard(length: int):
    def resolved(table: pa.Table) -> pa.Table:
        """Rows (uid, lo, hi, d1, d2): starts that repeat, without digests; or one open start, or a marker without uid."""
        table = table.sort_by([("fp", "ascending"), ("whole", "ascending"), ("uid", "ascending")])
        contexts = table.column("context").to_pylist()
        names, lows = table.column("uid").to_pylist(), table.column("lo").to_numpy()
        sizes = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
        ends = np.cumsum(sizes)
        begin = ends - sizes
        text = np.frombuffer(b"".join(contexts), np.uint8)
        stop = np.repeat(ends, sizes)
        number = {u: k for k, u in enumerate(dict.fromkeys(names))}
        owner = np.fromiter((number[u] for u in names), np.int64, len(names))
        offset = np.arange(text.size) - np.repeat(begin, sizes)
        place = np.repeat((owner << 40) + lows, sizes) + offset
        kinds, twice = repeated_starts(text, begin, stop, place, length)
        multi = np.repeat(table.column("multi").to_numpy(zero_copy_only=False).astype(bool), sizes)
        fits = stop - np.arange(text.size) >= length
        dup = fits & (twice | multi)
        a, b = runs(dup)
        # runs end at the borders of contexts, since the last starts of a context don't fit
        context_of = np.repeat(np.arange(len(names)), sizes)
        which = context_of[a]
        rows = [[names[k] for k in which], (lows[which] + a - begin[which]).tolist(), (lows[which] + b - begin[which]).tolist(), [None] * len(a), [None] * len(a)]
        hot = np.repeat(table.column("parts").to_numpy() > 1, sizes) & fits
        if hot.any():
            digest = [np.zeros(text.size, np.uint64) for _ in _ODD]
            for k in range(len(_ODD)):
                digest[k][: max(0, text.size - length + 1)] = gram_hashes(text, length, k)
            open_ = np.flatnonzero(hot & ~dup)
            shut = np.flatnonzero(hot & dup)
            shut = shut[np.unique(kinds[shut], return_index=True)[1]]
            for at, own in ((open_, True), (shut, False)):
                rows[0] += [names[k] for k in context_of[at]] if own else [None] * at.size
                start = (lows[context_of[at]] + offset[at]).tolist()
                rows[1] += start
                rows[2] += [s + 1 for s in start]
                rows[3] += digest[0][at].view(np.int64).tolist()
                rows[4] += digest[1][at].view(np.int64).tolist()
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["uid", "lo", "hi", "d1", "d2"])

    return resolved


def _merged(table: pa.Table) -> pa.Table:
    """Open starts whose digest another start of the bucket has, found by binary search in the sorted digests.

    A start that several contexts hold counts once; a marker stands for starts that repeat anyway.
    """
    table = table.group_by(["d1", "d2", "uid", "lo"]).aggregate([])
    keys = np.empty(table.num_rows, [("a", np.int64), ("b", np.int64)])
    keys["a"], keys["b"] = table.column("d1").to_numpy(), table.column("d2").to_numpy()
    line = np.sort(keys, order=["a", "b"])
    line = line.view(np.int64).reshape(-1, 2)
    first = np.searchsorted(line[:, 0], keys["a"], "left")
    last = np.searchsorted(line[:, 0], keys["a"], "right")
    several = np.flatnonzero(last - first > 1)
    hit = [i for i in several.tolist() if np.count_nonzero(line[first[i] : last[i], 1] == keys["b"][i]) > 1]
    found = table.select(["uid", "lo"]).take(pa.array(hit, pa.int64()))
    found = found.filter(pc.is_valid(found.column("uid")))
    return found.append_column("hi", pc.add(found.column("lo"), 1))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, lo, hi): ranges of starts in distinct ``texts`` (uid, text) at which a repeated string starts."""
    spark = texts.sparkSession
    anchors_at, contexts_at = common.work_path(spark, "anchors"), common.work_path(spark, "context-bytes")
    found = common.saved(_anchor_rows(texts, length), anchors_at, compression="zstd")
    often = found.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    again = common.written(found.join(often, "fp"), "repeated-anchors", compression="zstd")
    common.remove(spark, anchors_at)
    grouped = again.groupBy("fp", "whole").agg(F.count("*").alias("c"), F.min(F.struct("uid", "lo", "hi")).alias("one"))
    grouped = common.written(grouped, "contexts", compression="zstd")
    counts = grouped.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", F.ceil(F.col("n") / ANCHOR_CONTEXTS).cast("int").alias("parts"))
    wanted = grouped.join(counts, "fp").select("fp", "whole", F.col("one.uid").alias("uid"), F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"), (F.col("c") > 1).alias("multi"), "parts")
    cut = common.saved(_contexts(texts, wanted, length), contexts_at, compression="zstd")
    size = cut.agg(F.sum(F.length("context"))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("fp", F.pmod(F.xxhash64("whole"), F.col("parts"))), F.lit(shards)))
    local = common.written(dealt.groupBy("shard").applyInArrow(_shard(length), "uid binary, lo long, hi long, d1 long, d2 long"), "local-repeats", compression="zstd")
    common.remove(spark, contexts_at)
    open_ = local.where("d1 IS NOT NULL")
    buckets = max(1, -(-open_.count() // MERGE_ROWS))
    crossed = open_.withColumn("bucket", F.pmod(F.col("d1"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: _merged(t.drop_columns(["bucket"])), "uid binary, lo long, hi long")
    # anchors whose whole context repeats, wherever they are
    whole = again.join(grouped.where("c > 1").select("fp", "whole"), ["fp", "whole"]).select("uid", "lo", "hi")
    return local.where("d1 IS NULL").select("uid", "lo", "hi").union(crossed).union(whole)


def removal(text: bytes, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs, from ranges of starts; starts whose string would pass the end don't count."""
    hi = np.minimum(hi, len(text) - length + 1)
    ok = lo < hi
    lo, hi = lo[ok], hi[ok] + length - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if lo.size else hi
    if not lo.size:
        return lo, hi
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, lo.size - 1)]


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with text cleaned, and n_bytes, n_removed, n_spans, kept_sha256 of the bytes of the text that it had.

    Texts are UTF-8; a null text is empty and stays null. What is left of a cut character is dropped from
    the text, not from the digest. Equal texts of ``length`` bytes or more are removed as a whole, in every
    row. Shorter texts stay. An empty table gives an empty one; further columns are kept, and
    those named like a new one are replaced.

    Texts are shuffled once, to bring equal ones together; each is then a row of a table in buckets, and
    what is found about it comes to it. Rows with a text that others have too need no text any more.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*new)
    kept = docs.columns
    size, text = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.col("text")
    digest = lambda column: F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)
    short = docs.where(size < length).select(*kept, size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), digest(text).alias("kept_sha256"))
    rest = docs.where(size >= length).select(F.unhex(F.md5(text.cast("binary"))).alias("uid"), F.struct(*kept).alias("doc"), size.alias("size"))
    texts = common.bucketed(rest.groupBy("uid").agg(F.count("*").alias("copies"), F.first("doc").alias("doc")), "texts", "uid")
    several = common.written(texts.where("copies > 1").select("uid"), "copied")
    gone = rest.select("uid", "size", *[F.col("doc")[c].alias(f"_{k}") for k, c in enumerate(kept) if c != "text"]).join(several, "uid", "left_semi")
    copied = gone.select(*[F.lit("").alias(c) if c == "text" else F.col(f"_{k}").alias(c) for k, c in enumerate(kept)], F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), digest(F.lit("")).alias("kept_sha256"))
    found = repeats(texts.select("uid", F.col("doc.text").alias("text")), length).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    single = texts.where("copies = 1").join(found, "uid", "left").select("doc.*", F.col("ranges").alias("_ranges"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            rows = []
            for raw, at, end in zip((t.encode() for t in common.texts_of(block)), *_list_bounds(block.column("_ranges")), strict=True):
                ranges = block.column("_ranges").values
                lo, hi = removal(raw, ranges.field("lo").to_numpy()[at:end], ranges.field("hi").to_numpy()[at:end], length)
                edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(raw)]
                left = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                rows.append((left.decode(errors="ignore"), len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(left).hexdigest()))
            text, *columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([*[text if c == "text" else block.column(c) for c in kept], *columns], names=[*kept, *new])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(new, ("long", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    return common.map_arrow(single, cleaned, schema).union(copied).union(short)


def _list_bounds(lists: pa.ListArray) -> tuple[list[int], list[int]]:
    """Where each list starts and ends in the values; a null list is empty."""
    offsets = lists.offsets.to_numpy()
    end = np.where(lists.is_valid().to_numpy(zero_copy_only=False), offsets[1:], offsets[:-1])
    return offsets[:-1].tolist(), end.tolist()
