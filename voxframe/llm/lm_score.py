"""Language-model scores by a weighted backoff automaton over words.

Counts of all words of the training texts give the lowest order, add-one smoothed. All pairs and triples that the
training texts hold at least ``LEAST`` times get states and arcs: absolute discounting, and failure arcs with
the weights that make each state's probabilities sum to one. No share of the corpus is asked for, so the
automaton grows with it and is nowhere held as a whole: its words, pairs and triples are dealt to slices by 64-bit
hashes, counted there, and each block of documents gets back what its own texts can reach.

Words and pairs are counted first. A triple can only be seen ``LEAST`` times if both of its pairs are, so the others,
most of the distinct ones, are never dealt; nothing is lost by that.

The state before a token depends on the two words before it alone, so all tokens of a block step at once. Grams are
told apart by their hashes: among 8e9 distinct ones, those of about 30 GB, two are expected to collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from voxframe.llm import common
from voxframe.llm.shingles import mixed, word_hashes_of

#: Least count of a pair or triple with an arc.
LEAST, DISCOUNT = 2, 0.5
#: Slices of the hashes, at least, as a power of two; characters of the corpus for each slice and for each shuffle partition at most.
SLICE_BITS, SLICE_CHARS, PARTITION_CHARS = 11, 4_000_000, 48_000_000
#: Characters of a block's texts, or one longer text; tokens that are stepped at once.
PACK_BYTES, TOKENS = 4 << 20, 1 << 17
END = np.uint64(0x5EED0F7E47)


def packed(docs: DataFrame) -> DataFrame:
    """One row for each block of (doc_id, text, train): block and the columns as lists. Written once, so that every pass sees the same blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids, texts, train = zip(*held, strict=True)
            return pa.record_batch([pa.array([part << 32 | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), pa.array([train], pa.list_(pa.bool_()))], names=["block", "ids", "texts", "train"])

        for batch in batches:
            for doc_id, text, train in zip(batch.column("doc_id").to_pylist(), common.texts_of(batch), batch.column("train").to_pylist(), strict=True):
                if held and size + len(text) > PACK_BYTES:
                    yield row()
                    held.clear()
                    size, number = 0, number + 1
                held.append((doc_id, text, train))
                size += len(text)
        if held:
            yield row()

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text", "train"), pack, "block long, ids array<long>, texts array<string>, train array<boolean>")


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value begins in sorted ones."""
    return np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))


def places(runs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct values of all ``runs`` and the place of each run's values among them."""
    flat = np.concatenate(runs)
    order = np.argsort(flat)
    flat = flat[order]
    first = firsts(flat)
    place = np.empty(flat.size, np.int32)
    place[order] = np.repeat(np.arange(first.size, dtype=np.int32), np.diff(np.append(first, flat.size)))
    return flat[first], np.split(place, np.cumsum([r.size for r in runs])[:-1])


@dataclass
class Grams:
    """The runs of up to three tokens in a block's texts.

    ``at[n][i]`` is the place of the run of n + 1 tokens that ends at token i among the sorted distinct
    ``keys`` (words and pairs) or ``triples``, -1 where its text begins later or the run can't be seen ``LEAST`` times.
    """

    sizes: np.ndarray
    keys: np.ndarray
    at: list[np.ndarray]
    runs: list[np.ndarray]
    triples: np.ndarray | None = None
    whole: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        sizes, words = word_hashes_of(texts, END)
        runs = [words]
        for step in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
            runs.append(mixed(np.concatenate([[np.uint64(0)], runs[-1][:-1]]) * step + words))
        begin = np.cumsum(sizes) - sizes
        inner = np.ones(words.size, bool)
        inner[begin] = False
        # keys of words are even, those of pairs odd
        keys, (word, within) = places([words & ~np.uint64(1), runs[1][inner] | np.uint64(1)])
        pair = np.full(words.size, -1, np.int32)
        pair[inner] = within
        whole = inner.copy()
        whole[begin[sizes > 1] + 1] = False
        return cls(sizes, keys, [word, pair], runs, None, whole)

    def with_triples(self, totals: np.ndarray) -> Grams:
        """The triples whose pairs were both seen ``LEAST`` times; ``totals`` are those of ``keys``."""
        often = (self.at[1] >= 0) & (totals[self.at[1]] >= LEAST)
        held = self.whole & often
        held[1:] &= often[:-1]
        self.triples, (within,) = places([self.runs[2][held]])
        triple = np.full(held.size, -1, np.int32)
        triple[held] = within
        self.at.append(triple)
        self.runs = []
        return self


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers as one byte of width and values of that width."""
    top = int(values.max()) if values.size else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def stepped(keys: np.ndarray) -> bytes:
    """Ascending keys as one byte of width, the first key and the steps between them in that width."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if steps.size else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unstepped(raw: bytes) -> np.ndarray:
    width, steps = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    full = np.zeros((steps.size // width + 1, 8), np.uint8)
    full[1:, :width] = steps.reshape(-1, width)
    full[0] = np.frombuffer(raw, np.uint8, 8, 1)
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def rows_of(block: int, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each slice that has keys of the block: its keys and their values."""
    slices = keys >> np.uint64(64 - bits)
    first = firsts(slices)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), keys.size], strict=True)) if keys.size else []
    return pa.record_batch([pa.array(slices[first].astype(np.int32)), pa.array(np.full(first.size, block)), pa.array([stepped(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([narrow(values[a:b].ravel()) for a, b in cuts], pa.binary())], names=["slice", "block", "keys", "values"])


ROWS = "slice int, block long, keys binary, values binary"


def summed(rows: DataFrame, width: int, owners: bool, partitions: int) -> DataFrame:
    """(block, slice, values, n, v): the values of equal keys added over all blocks, returned to each block in its keys' order.

    With ``owners`` a sum is doubled, and one more for one of the blocks that hold the key; n is then the sum over the
    even keys of the slice, in one of its rows, and v how many of them have one.
    """

    def merge(slice_: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, values = np.concatenate([k for _, k, _ in held]), np.concatenate([v for _, _, v in held]).reshape(-1, width)
        order = np.argsort(keys)
        first = firsts(keys[order])
        sums = np.add.reduceat(values[order], first, axis=0) << int(owners)
        out = np.empty_like(values)
        out[order] = np.repeat(sums, np.diff(np.append(first, keys.size)), axis=0)
        n = v = 0
        if owners:
            out[order[first]] += 1
            even = sums[keys[order[first]] & np.uint64(1) == 0, 0] >> 1
            n, v = int(even.sum()), int((even > 0).sum())
        ends = np.cumsum([k.size for _, k, _ in held])
        parts = [narrow(out[e - k.size : e].ravel()) for e, (_, k, _) in zip(ends, held, strict=True)]
        return pa.record_batch([pa.array([b for b, _, _ in held], pa.int64()), pa.array([slice_] * len(held), pa.int32()), pa.array(parts, pa.binary()), *[pa.array([x, *[0] * (len(held) - 1)], pa.int64()) for x in (n, v)]], names=["block", "slice", "values", "n", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for slice_, block, keys, values in zip(*(batch.column(c).to_pylist() for c in ("slice", "block", "keys", "values")), strict=True):
                if held and slice_ != now:
                    yield merge(now, held)
                    held = []
                now = slice_
                held.append((block, unstepped(keys), wide(values)))
        if held:
            yield merge(now, held)

    return common.map_arrow(rows.repartition(partitions, "slice").sortWithinPartitions("slice"), merged, "block long, slice int, values binary, n long, v long")


def by_block(sums: DataFrame, name: str, partitions: int) -> DataFrame:
    """(block, name): the values of a block's slices in order."""
    return sums.repartition(partitions, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", "values"))).alias("list")).select("block", F.col("list.values").alias(name))


def joined(parts: pa.ListScalar) -> np.ndarray:
    held = [wide(p) for p in parts.as_py() or []]
    return np.concatenate(held) if held else np.zeros(0, np.int64)


def each_block(blocks: DataFrame, columns: tuple[str, ...], function: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """One batch from the named columns of each block, one block in memory at a time."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in columns), strict=True):
                yield function(*row)

    return common.map_arrow(blocks, mapped, schema)


def trained(places_: np.ndarray, use: np.ndarray, keys: int) -> np.ndarray:
    return np.bincount(places_[use & (places_ >= 0)], minlength=keys)


def used(train: pa.ListScalar, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.array(train.as_py(), bool), sizes)


def asked_of(grams: Grams, totals: np.ndarray) -> np.ndarray:
    """The places of keys that are states: words and pairs with arcs or a failure weight to look up."""
    state = np.zeros(grams.keys.size, bool)
    state[grams.at[0]] = True
    pairs = grams.at[1][grams.at[1] >= 0]
    state[pairs[totals[pairs] >= LEAST]] = True
    return np.flatnonzero(state)


def state_sums(grams: Grams, signed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each key as a state, sums over the arcs that this block owns: of their counts, of arcs and of the counts that the failure state has of the arcs' words."""
    totals = [x >> 1 for x in signed]
    sums = np.zeros((grams.keys.size, 3), np.int64)
    for n, (own, total, below) in ((1, (signed[0], totals[0], totals[0])), (2, (signed[1], totals[1], totals[0]))):
        arc = grams.at[n]
        # one token for each owned arc
        here = np.flatnonzero(arc >= 0)
        here = here[(own[arc[here]] & 1 == 1) & (total[arc[here]] >= LEAST)]
        last = np.zeros(own.size, np.int64)
        last[arc[here]] = here
        here = here[last[arc[here]] == here]
        state = grams.at[n - 1][here - 1]
        for k, x in enumerate((total[arc[here]], np.ones(here.size), below[grams.at[n - 1][here]])):
            sums[:, k] += np.bincount(state, x, grams.keys.size).astype(np.int64)
    return sums


def token_scores(grams: Grams, totals: np.ndarray, triples: np.ndarray, asked: np.ndarray, sums: np.ndarray, mass: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token by the lowest order and by the automaton; ``sums`` are those of the arcs of the states ``asked``.

    A token's state depends on the two tokens before it, all within its text, so windows of tokens are stepped one after the other.
    """
    slot = np.full(grams.keys.size, asked.size, np.int32)
    slot[asked] = np.arange(asked.size, dtype=np.int32)
    sums, triples = np.concatenate([sums, np.zeros((1, 3), np.int64)]), np.append(triples, 0)
    base, full = np.empty(grams.at[0].size), np.empty(grams.at[0].size)

    def weight(state: np.ndarray, count_of: np.ndarray, least: float, under: np.ndarray | int) -> np.ndarray:
        """The failure arc's weight: what the state leaves over its arcs, by what the lower state has beside their words."""
        count, arcs, below = sums[slot[state]].T
        left, taken = (count - DISCOUNT * arcs) / count_of, (below + least * arcs) / under
        return np.where(arcs > 0, np.log10(np.maximum(1 - left, 1e-12) / np.maximum(1 - taken, 1e-12)), 0.0)

    for lo in range(0, base.size, TOKENS):
        # the window's first token but one is there for the state of the next alone
        own = slice(max(0, lo - 1), lo + TOKENS)
        word, pair, triple = (at[own] for at in grams.at)
        c1, c2, c3 = totals[word], np.where(pair >= 0, totals[pair], 0), triples[triple]
        before, c2_before = np.append(0, c1[:-1]), np.append(0, c2[:-1])
        lowest = np.log10(c1 + 1.0) - np.log10(float(mass))
        known, broad = np.maximum(before, 1), np.maximum(c2_before, 1)
        two = weight(np.append(word[:1], word[:-1]), known, 1.0, mass) + lowest
        two = np.where(c2 >= LEAST, np.log10(np.maximum(c2 - DISCOUNT, DISCOUNT) / known), two)
        two = np.where(pair >= 0, two, lowest)
        three = weight(np.append(pair[:1], pair[:-1]), broad, -DISCOUNT, known) + two
        three = np.where(c3 >= LEAST, np.log10(np.maximum(c3 - DISCOUNT, DISCOUNT) / broad), three)
        score = np.where(grams.whole[own] & (c2_before >= LEAST), three, two)
        base[lo : lo + TOKENS], full[lo : lo + TOKENS] = lowest[lo - own.start :], score[lo - own.start :]
    return base, full


def held_out(doc_id: Column) -> Column:
    return F.coalesce(common.crc_bucket(doc_id, 7) == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text).

    A null or empty text is the end alone. Repeated rows count and are scored each; a null doc_id
    is in training. An empty table gives an empty one; other columns are ignored.
    The counts are made when this is called; the scores when the result is read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"))
    size = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    bits = max(SLICE_BITS, int(size / SLICE_CHARS).bit_length())
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_CHARS))
    blocks = common.bucketed(packed(docs), "blocks", "block", partitions)

    def word_rows(block, texts, train):
        grams = Grams.of(texts.as_py())
        use = used(train, grams.sizes)
        return rows_of(block.as_py(), grams.keys, sum(trained(at, use, grams.keys.size) for at in grams.at), bits)

    def triple_rows(block, texts, train, signed):
        grams = Grams.of(texts.as_py()).with_triples(joined(signed) >> 1)
        return rows_of(block.as_py(), grams.triples, trained(grams.at[2], used(train, grams.sizes), grams.triples.size), bits)

    def state_rows(block, texts, signed, signed3):
        grams, signed, signed3 = Grams.of(texts.as_py()), joined(signed), joined(signed3)
        asked = asked_of(grams.with_triples(signed >> 1), signed >> 1)
        return rows_of(block.as_py(), grams.keys[asked], state_sums(grams, (signed, signed3))[asked], bits)

    def counts(rows, width, owners, name):
        return common.written(summed(rows, width, owners, partitions), name, compression="zstd")

    low = counts(each_block(blocks, ("block", "texts", "train"), word_rows, ROWS), 1, True, "gram-sums")
    known = blocks.join(by_block(low, "totals", partitions), "block")
    high = counts(each_block(known, ("block", "texts", "train", "totals"), triple_rows, ROWS), 1, True, "triple-sums")
    known = known.join(by_block(high, "triples", partitions), "block", "left")
    sums = counts(each_block(known, ("block", "texts", "totals", "triples"), state_rows, ROWS), 3, False, "state-sums")
    whole = low.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, distinct = int(whole["n"] or 0), int(whole["v"] or 0)

    def traverse(ids, texts, train, signed, signed3, own):
        totals, triples = joined(signed) >> 1, joined(signed3) >> 1
        grams = Grams.of(texts.as_py()).with_triples(totals)
        begin = np.cumsum(grams.sizes) - grams.sizes
        base, full = (np.add.reduceat(x, begin) for x in token_scores(grams, totals, triples, asked_of(grams, totals), joined(own).reshape(-1, 3), tokens + distinct + 1))
        n_known = np.add.reduceat((totals[grams.at[0]] > 0).astype(np.int64), begin)
        return pa.record_batch([ids.values, pa.array([not t for t in train.as_py()]), pa.array(grams.sizes), pa.array(n_known), pa.array([tokens] * len(n_known), pa.int64()), pa.array(base), pa.array(full)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return each_block(known.join(by_block(sums, "sums", partitions), "block"), ("ids", "texts", "train", "totals", "triples", "sums"), traverse, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
