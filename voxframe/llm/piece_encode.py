"""Merge-type subword encoding by a prefix table, and decoding.

The encoding of each prefix of a chunk ends in exactly one token. An automaton finds the
vocabulary pieces that end at a position; of these, the one whose neighbour on the left,
the last token of the prefix before it, would not have merged with it or with a part of it, is
that prefix's last token. The ids are then read off backwards. This takes a number of steps in
proportion to the length, whatever the merges.

No piece holds a space mark after another character, so a text is encoded chunk by
chunk, a chunk being a word with the space marks before it. Characters without a piece become byte
tokens and separate what stands around them. Marks of runs merge last, all at one score, from the left.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxframe.llm import common

MARK = "▁"
#: Chunks, and pairs, that a worker remembers: about 200 and 100 bytes each.
TABLE_CHUNKS, TABLE_PAIRS = 600_000, 400_000


class PieceEncoder:
    """Encoder for a merge-type model of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.text = {i: sp.id_to_piece(i) for i in ids if i not in special}
        self.id_of = {t: i for i, t in self.text.items()}
        self.score = {i: sp.get_score(i) for i in self.text}
        runs = {t for t in self.id_of if len(t) > 1 and not t.strip(MARK)}
        inner = [t for t in self.id_of if t not in runs and MARK in t[1:]]
        words = [t for t in self.id_of if t not in runs and len(t) > 1]
        last_of_words = min(self.score[self.id_of[t]] for t in words)
        if len(self.bytes_at) != 256 or inner or len({self.score[self.id_of[t]] for t in words}) < len(words) or any(self.score[self.id_of[t]] >= last_of_words for t in runs):
            raise ValueError("the prefix table needs byte pieces, distinct scores and space marks at the start of pieces only")
        self.run_table: dict[int, list[int]] = {}
        self.rank = dict.fromkeys(self.text, -1) | {self.id_of[t]: r for r, t in enumerate(sorted(words, key=lambda t: -self.score[self.id_of[t]]))}
        self.left, self.right, self.pair = {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            if len(t) > 1 and t not in runs:
                parts = self.merges(t, runs)
                if parts is None:
                    continue
                self.left[i], self.right[i] = parts
                self.pair[parts[0] << 16 | parts[1]] = self.rank[i]
            if t not in runs:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.known = {t for t in self.id_of if len(t) == 1}
        self.compatible: dict[int, bool] = {}
        self.adjacent = {t[k : k + 2] for t in self.id_of if t not in runs for k in range(len(t) - 1)}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.decimal = [str(i) for i in ids]
        self.table: dict[str, bytes] = {}

    def merges(self, text: str, runs: set[str]) -> tuple[int, int] | None:
        """The pair whose merge completes ``text``; None if merging never gets there."""
        symbols = list(text)
        if any(s not in self.id_of for s in symbols):
            return None
        while len(symbols) > 2:
            best = max(((self.score[self.id_of[a + b]], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.id_of and a + b not in runs), default=None)
            if best is None:
                return None
            k = -best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return self.id_of[symbols[0]], self.id_of[symbols[1]]

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay as they are under the merges.

        The merges that made them are undone from the last; a merge across the border that would have
        come before the one undone, the left of two equal ones coming first, speaks against.
        """
        key = a << 16 | b
        got = self.compatible.get(key)
        if got is not None:
            return got
        limit, ok, pair, rank = 1 << 30, True, self.pair, self.rank
        while True:
            across = pair.get(a << 16 | b)
            if across is not None and across < limit:
                ok = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                break
        if len(self.compatible) >= TABLE_PAIRS:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def run(self, n: int) -> list[int]:
        """The tokens of n space marks in a row."""
        got = self.run_table.get(n)
        if got is not None:
            return got
        size, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        fits = lambda k: after[k] >= 0 and MARK * min(size[k] + size[after[k]], 1 << 10) in self.id_of
        queue = [k for k in range(n) if fits(k)]
        while queue:
            k = heapq.heappop(queue)
            if not size[k] or not fits(k):
                continue
            gone = after[k]
            size[k] += size[gone]
            size[gone], after[k] = 0, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and fits(x):
                    heapq.heappush(queue, x)
        out = [self.id_of[MARK * s] for s in size if s]
        if n < 1000:
            self.run_table[n] = out
        return out

    def known_span(self, span: str, shared: int = 0, last: list[int] | None = None) -> list[int]:
        """The prefix table of a span of known characters; its first ``shared`` entries are given."""
        last = [-1] * (len(span) + 1) if last is None else last[: shared + 1] + [-1] * (len(span) - shared)
        stays, compatible = self.stays, self.compatible
        for end, (token, length) in self.automaton.iter(span):
            end += 1
            if end <= shared or last[end] >= 0:
                continue
            at = end - length
            if at == 0:
                last[end] = token
            else:
                ok = compatible.get(last[at] << 16 | token)
                if ok or ok is None and stays(last[at], token):
                    last[end] = token
        return last

    def ids_of(self, span: str, last: list[int]) -> list[int]:
        out, at, length = [], len(span), self.length
        while at:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks in sorted order, so that common prefixes share their table.

        A last character that no piece joins to the one before it, such as a comma after a
        letter, is a token of its own.
        """
        table, known, adjacent, previous, last = self.table, self.known, self.adjacent, "", [-1]
        for chunk in sorted(chunks):
            tail = b""
            if len(chunk) > 1 and chunk[-2:] not in adjacent and chunk[-1] in known:
                base, tail = chunk[:-1], array("H", [self.id_of[chunk[-1]]]).tobytes()
                got = table.get(base)
                if got is not None:
                    table[chunk] = got + tail
                    continue
            else:
                base = chunk
            span = MARK + base
            if known.issuperset(span):
                shared, most = 0, min(len(previous), len(span))
                while shared < most and previous[shared] == span[shared]:
                    shared += 1
                last, previous = self.known_span(span, shared, last), span
                ids = self.ids_of(span, last)
            else:
                ids, at = [], 0
                for k, c in enumerate(span + "\0"):
                    if c not in known:
                        if k > at:
                            ids += self.ids_of(span[at:k], self.known_span(span[at:k]))
                        if k < len(span):
                            ids += [self.bytes_at[b] for b in c.encode()]
                        at = k + 1
            table[base] = got = array("H", ids).tobytes()
            if tail:
                table[chunk] = got + tail

    def encode_many(self, texts: list[str]) -> Iterator[array]:
        """Per text its ids, as an array of 16-bit integers."""
        split = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        seen = set().union(*split) if split else set()
        fresh = [c for c in seen if c not in self.table]
        if len(self.table) + 2 * len(fresh) > TABLE_CHUNKS:
            self.table.clear()
            fresh = list(seen)
        self.learn(fresh)
        for parts in split:
            yield self.with_runs(parts) if "" in parts else array("H", b"".join([self.table[p] for p in parts]))

    def with_runs(self, parts: list[str]) -> array:
        ids: list[int] = []
        lone, mark = 0, self.id_of[MARK]
        for p in parts:
            if not p:
                lone += 1
                continue
            own = array("H", self.table[p]).tolist()
            if lone:
                ids += self.run(lone + 1) + own[1:] if own[0] == mark else self.run(lone) + own
            else:
                ids += own
            lone = 0
        ids += self.run(lone) if lone else []
        return array("H", ids)


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Whole texts of (doc_id, text) as doc_id, ids (array of int) and decoded text.

    A null or empty text has no ids and decodes to the empty text. Texts of any length are encoded
    whole; repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        for block in common.blocks(batches, limit=6 << 20):
            ids = [np.asarray(x, np.int32) for x in coder.encode_many(common.texts_of(block))]
            yield pa.record_batch([block.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.library.decode(x.tolist()) for x in ids])], names=["doc_id", "ids", "decoded"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), coded, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``encode``, with digests in place of the ids and the decoded text."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path)
        for block in common.blocks(batches, limit=6 << 20):
            rows = []
            for own in coder.encode_many(common.texts_of(block)):
                ids = own.tolist()
                decimals = ",".join([coder.decimal[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()))
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.record_batch([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
