"""Hashes of words and of word shingles in whole texts, vectorised over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))
_STEPS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` begins, and its hash."""
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    inside = ~_IS_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not begin.size:
        return begin, np.zeros(0, np.uint64)
    place = np.arange(raw.size) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [raw.size]])))
    longest = int((end - begin).max())
    powers = _POWERS if longest <= _POWERS.size else np.cumprod(np.full(longest, _BASE, np.uint64))
    value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, powers.size - 1)], np.uint64(0))
    return begin, mixed(np.add.reduceat(value, begin) ^ ((end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8 ``data``, in order.

    A word's hash is a polynomial of its bytes, times its length's own factor, mixed.
    """
    return _hashed(data)[1]


def word_hashes_of(texts: list[str], end: np.uint64, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each text has, and the hashes of all texts in a row: those of its words, then ``end``.

    Texts are hashed together in blocks of about ``block`` bytes.
    """
    raw, sizes, out, lo, held = [t.encode() for t in texts], [], [], 0, 0
    for hi, t in enumerate(raw, 1):
        held += len(t) + 1
        if held < block and hi < len(raw):
            continue
        own = raw[lo:hi]
        begin, hashes = _hashed(b"\n".join(own))
        last = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in own]) - 1)
        sizes.append(np.diff(last, prepend=0) + 1)
        out.append(np.insert(hashes, last, end))
        lo, held = hi, 0
    return np.concatenate(sizes), np.concatenate(out)


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle; without words none."""
    words = word_hashes(data)
    if not words.size:
        return words
    size = min(width, words.size)
    n = words.size - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = (total ^ words[k : k + n]) * _STEPS[k]
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))
