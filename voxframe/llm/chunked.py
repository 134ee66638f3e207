"""Whole-text encoding by the tokenizers library with one model call per distinct chunk.

Both vocabularies split a text into pretokens before merging, so a text's ids are the
ids of its space-separated chunks, one after the other, wherever the cut can't change
the pretokens. A block of texts is cut at once in numpy. Chunks of up to 15 bytes are two 64-bit
numbers, their bytes and length, and are looked up side by side in a table with one place for each
hash; what its place does not hold is encoded by the library and takes the place. Ids lie in
one pool. Table and pool have fixed sizes in bytes.

By default the strings of added tokens, such as an end of text, are text like any other, as in the library with
``encode_special_tokens``; with ``match_added`` they become their ids, as in the library as it loads.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import regex

#: Marks that a pattern of pretokens splits from the letters before them.
MARKS = frozenset(".,;:!?|#$%&*()")
#: Places of a worker's table as a power of two (24 bytes each), ids of its pool (4 bytes each), and entries of
#: its two dictionaries (pretokens, chunks of 16 to 64 bytes; about 250 bytes an entry): some 100 MB.
TABLE_BITS, POOL_IDS, DICT_ENTRIES = 20, 4 << 20, 100_000
#: Chunks that are looked up at once.
WINDOW = 1 << 16
#: Longest chunk that is two numbers, and that a dictionary keeps.
SHORT, LONG = 15, 64
#: What a byte is to the rules of cutting.
OTHER, SPACE, LINE, VISIBLE, MARK, LETTER = range(6)
KIND = np.array([SPACE if b == 32 else LINE if b == 10 else LETTER if chr(b).isalpha() and b < 128 else MARK if chr(b) in MARKS else VISIBLE if 32 < b < 127 else OTHER for b in range(256)], np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins of the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes whole texts to uint32 ids; subclasses say how texts are cut and how a chunk is encoded."""

    def __init__(self, path: str, match_added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder() if match_added else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"added tokens of {path} match more or less than their own string")
        self.added = {t.content: k for k, t in added.items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.space = self.alphabet[32]
        self.pretokens: dict[str, bytes] = {}
        self.pool = np.empty(POOL_IDS, np.uint32)
        self.forget()

    def forget(self) -> None:
        """Empty table and pool."""
        self.low, self.high = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.uint64)
        self.place, self.count = np.zeros(1 << TABLE_BITS, np.int32), np.zeros(1 << TABLE_BITS, np.int32)
        self.longer: dict[bytes, tuple[int, int]] = {}
        self.used = 0

    def whole(self, text: str) -> bytes:
        """The library's own encoding of a piece of text."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, pretoken: str) -> bytes:
        """The ids of one pretoken, by the library's merge model alone."""
        got = self.pretokens.get(pretoken)
        if got is None:
            if pretoken.isascii() and pretoken.isprintable():
                coded = pretoken.replace(" ", self.space)
            else:
                coded = pretoken.encode().decode("latin1").translate(self.alphabet)
            got = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
            if len(pretoken) <= LONG:
                if len(self.pretokens) >= DICT_ENTRIES:
                    self.pretokens.clear()
                self.pretokens[pretoken] = got
        return got

    def word(self, chunk: str) -> bytes | None:
        """The ids of a chunk that is letters, or letters and one mark, perhaps after a space."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return self.merged(chunk)
        if body[:-1].isalpha() and body[-1] in MARKS:
            return self.merged(chunk[:-1]) + self.merged(chunk[-1])
        return None

    def chunk(self, chunk: str) -> bytes:
        """The ids of one chunk."""
        raise NotImplementedError

    def cuts(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of the texts raw[begins:ends] start and end; none crosses a text's end, and a zero byte follows each text."""
        raise NotImplementedError

    def looked_up(self, data: bytes, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids' source, and where the ids of each chunk begin in it and how many they are."""
        eight = np.ndarray(raw.size - 7, "<u8", raw, strides=(1,))
        low = eight[starts] & _MASK[np.minimum(sizes, 8)]
        high = (eight[starts + 8] & _MASK[np.clip(sizes - 8, 0, 7)]) | (np.minimum(sizes, SHORT + 1).astype(np.uint64) << np.uint64(56))
        mixed = (low * _ODD[0]) ^ (high * _ODD[1])
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[2]
        slot = (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        hit = (self.low[slot] == low) & (self.high[slot] == high) & (sizes <= SHORT)
        place, count = self.place[slot], self.count[slot]
        missing = np.flatnonzero(~hit)
        found: dict[bytes, int] = {}
        keys = [data[a : a + n] for a, n in zip(starts[missing].tolist(), sizes[missing].tolist(), strict=True)]
        turn = np.fromiter((found.setdefault(key, len(found)) for key in keys), np.int64, len(keys))
        fresh, known = [], []
        at = self.used
        for key in found:
            got = self.longer.get(key) if len(key) > SHORT else None
            if got is None:
                ids = self.chunk(key.decode())
                got = (at, len(ids) // 4)
                fresh.append(ids)
                at += got[1]
                if SHORT < len(key) <= LONG and len(self.longer) < DICT_ENTRIES:
                    self.longer[key] = got
            known.append(got)
        if known:
            place[missing], count[missing] = np.array(known, np.int32)[turn].T
        new = missing[sizes[missing] <= SHORT]
        added = np.frombuffer(b"".join(fresh), np.uint32)
        if at <= POOL_IDS:
            self.pool[self.used : at] = added
            self.used = at
            taken = slot[new]
            self.low[taken], self.high[taken], self.place[taken], self.count[taken] = low[new], high[new], place[new], count[new]
            return self.pool, place, count
        source = np.concatenate([self.pool[: self.used], added])
        self.forget()
        return source, place, count

    def plain_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        data = b"\0".join(texts) + bytes(32)
        raw = np.frombuffer(data, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        starts, stops = self.cuts(raw, ends - lengths, ends)
        parts, counts = [], []
        for lo in range(0, starts.size, WINDOW):
            own = starts[lo : lo + WINDOW]
            source, place, count = self.looked_up(data, raw, own, stops[lo : lo + WINDOW] - own)
            after = np.cumsum(count)
            parts.append(source[np.repeat(place - after + count, count) + np.arange(int(after[-1]))])
            counts.append(count)
        after = np.cumsum(np.concatenate(counts), dtype=np.int64) if counts else np.zeros(0, np.int64)
        of_texts = np.concatenate([[0], after])[np.searchsorted(starts, ends)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.diff(of_texts, prepend=0)

    def encode_many(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with ``end_id`` after it if there is one, and the place after each text's ids.

        What lies between added tokens is encoded as texts of their own.
        """
        pieces, owner, marks = [], [], []
        for k, t in enumerate(texts):
            if self.added_pattern is not None and self.added_pattern.search(t):
                parts = self.added_pattern.split(t)
                pieces += [p.encode() for p in parts[::2]]
                marks += [self.added[p] for p in parts[1::2]] + [end_id]
                owner += [k] * (len(parts) // 2 + 1)
            else:
                pieces.append(t.encode())
                marks.append(end_id)
                owner.append(k)
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, counts = self.plain_many(pieces)
        held = np.fromiter((m is not None for m in marks), bool, len(marks))
        if held.any():
            own = np.cumsum(counts + held) - 1
            out = np.empty(ids.size + int(held.sum()), np.uint32)
            kept = np.ones(out.size, bool)
            kept[own[held]] = False
            out[kept] = ids
            out[own[held]] = [m for m in marks if m is not None]
            ids = out
        return ids, np.cumsum(np.bincount(owner, counts + held, len(texts)).astype(np.int64))

    def encode(self, text: str) -> bytes:
        """The ids of one whole text, little-endian."""
        return self.encode_many([text])[0].astype("<u4").tobytes()


class ByteChunks(ChunkEncoder):
    """Byte-level vocabulary whose pretokens may start with one space.

    Cuts that never change pretokens: before a space that a non-space follows, between a letter and a mark, before a
    line end after a visible character, and between that and a letter. Chunks have their leading space.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PLAIN = re.compile(r" ?[\n!-~¡-ɏ]+")

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        ids = self.word(chunk)
        if ids is not None:
            return ids
        if self.PLAIN.fullmatch(chunk):
            return b"".join([self.merged(p) for p in self.PATTERN.findall(chunk)])
        return self.whole(chunk)

    def cuts(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = KIND[raw[: ends[-1] + 1]]
        cut = np.zeros(kind.size, bool)
        spaces = np.flatnonzero(kind == SPACE)
        lead = raw[spaces + 1]
        good = lead > 32
        # lead bytes of characters some of which are white space: these are not cut at
        odd = np.flatnonzero((lead == 0xC2) | ((lead >= 0xE1) & (lead <= 0xE3)))
        if odd.size:
            first, second, third = lead[odd], raw[spaces[odd] + 2], raw[spaces[odd] + 3]
            good[odd] = ((first == 0xC2) & (second > 0xA0)) | ((first == 0xE1) & (second != 0x9A)) | ((first == 0xE2) & ((second > 0x81) | ((second == 0x80) & (third >= 0x90) & (third < 0xA8)))) | ((first == 0xE3) & ((second != 0x80) | (third != 0x80)))
        cut[1:] = (kind[1:] == MARK) & (kind[:-1] == LETTER)
        lines = np.flatnonzero(kind == LINE)
        lines = lines[lines > 0]
        lines = lines[kind[lines - 1] >= VISIBLE]
        cut[lines] = True
        cut[lines[kind[lines + 1] == LETTER] + 1] = True
        cut[spaces[good]] = True
        cut[begins] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], ends[-1])
        stops[np.searchsorted(starts, ends, "right") - 1] = ends
        return starts, stops


class WordChunks(ChunkEncoder):
    """Vocabulary with word ends: lower case, white space dropped, so white space is a cut, as is a mark after a letter.

    Chunks of ASCII go to the merge model directly; others take the library's whole path,
    with its normal form and lower case.
    """

    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    GAP = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0D])

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        lower = chunk.lower()
        ids = self.word(lower) if chunk.isascii() else None
        if ids is not None:
            return ids
        if chunk.isascii() and chunk.isprintable():
            return b"".join([self.merged(p) for p in self.PATTERN.findall(lower)])
        if unicodedata.is_normalized("NFC", chunk) and chunk.isprintable() and max(chunk) < "ɐ" and "İ" not in chunk:
            return b"".join([self.merged(p) for p in self.PATTERN.findall(lower)])
        return self.whole(chunk)

    def cuts(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = KIND[raw[: ends[-1] + 1]]
        gap = self.GAP[raw[: ends[-1] + 1]]
        gap[ends] = True
        start, stop = ~gap, np.zeros(gap.size, bool)
        start[1:] &= gap[:-1]
        stop[1:] = gap[1:] & ~gap[:-1]
        mark = np.flatnonzero((kind[1:] == MARK) & (kind[:-1] == LETTER)) + 1
        start[mark] = stop[mark] = True
        return np.flatnonzero(start), np.flatnonzero(stop)


_LOADED: dict[tuple[type, str, bool], ChunkEncoder] = {}


def encoder(kind: type[ChunkEncoder], path: str, match_added: bool = False) -> ChunkEncoder:
    """This worker's encoder."""
    if (kind, path, match_added) not in _LOADED:
        _LOADED[kind, path, match_added] = kind(path, match_added)
    return _LOADED[kind, path, match_added]
