"""Media columns: baseline JPEG bytes, written, parsed and decoded in numpy.

``encode`` stores a payload without loss: each byte is one quantized coefficient of a grey image, in
scan order, all quantizers 1, so an entropy decoder gets the bytes back. The Huffman tables suit text,
and a restart marker follows every three blocks. ``decode_many`` reads any baseline file, with
one interleaved scan or several: all restart intervals of all files advance side by side, a symbol at a time. The
DC coefficients alone give the luminance thumbnail.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxframe.llm import common

UNIT, ZERO_BYTE, RESTART = 192, 113, 3
#: Blocks that are encoded at once, whole restart intervals.
SLICE = 1024 * RESTART


def _codes(lengths: dict[int, int]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Counts, symbols, code and length of each symbol for given code lengths, in canonical order."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, codes, sizes = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s], sizes[s] = code, size
        code += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return counts, bytes(order), codes, sizes


_AC_LENGTHS = {0x02: 2, 0x04: 2, 0x07: 3, 0x03: 3, 0x01: 4, 0x05: 4, 0x08: 5, 0x06: 5, 0x00: 6}
_AC_LENGTHS |= {0x10 | s: 9 for s in range(1, 9)} | {r << 4 | s: 13 for r in range(2, 16) for s in range(1, 9)} | {0xF0: 13}
_DC = _codes(dict.fromkeys(range(9), 4))
_AC = _codes(_AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _size_of(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _scan(c: np.ndarray, interval: int) -> bytes:
    """The entropy-coded restart intervals of blocks ``c``, the first of which is number ``interval``, with the markers before them."""
    total = len(c)
    step = c[:, 0].copy()
    step[1:] -= np.where(np.arange(1, total) % RESTART == 0, 0, c[:-1, 0])
    value, length = np.zeros((total, 65), np.uint64), np.zeros((total, 65), np.int64)
    size = _size_of(step)
    bits = np.where(step < 0, step + (1 << size) - 1, step).astype(np.uint64)
    value[:, 0], length[:, 0] = (_DC[2][size] << size.astype(np.uint64)) | bits, _DC[3][size] + size
    where, at = np.nonzero(c[:, 1:])
    at = at + 1
    before = np.concatenate([[0], at[:-1]])
    before[np.concatenate([[True], where[1:] != where[:-1]])[: at.size]] = 0
    run = at - before - 1
    v = c[where, at]
    size = _size_of(v)
    symbol = (run % 16) << 4 | size
    code = (_AC[2][symbol] << size.astype(np.uint64)) | np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
    count = _AC[3][symbol] + size
    for _ in range(3):
        longer = run >= 16
        if not longer.any():
            break
        code = np.where(longer, (_AC[2][0xF0] << count.astype(np.uint64)) | code, code)
        count = count + np.where(longer, _AC[3][0xF0], 0)
        run = np.where(longer, run - 16, run)
    value[where, at], length[where, at] = code, count
    short = c[:, 63] == 0
    value[short, 64], length[short, 64] = _AC[2][0], _AC[3][0]
    segment = np.arange(total) // RESTART
    own = np.bincount(segment, length.sum(axis=1)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(-(-own // 8) * 8)])
    value, count = value.ravel(), length.ravel()
    used = np.flatnonzero(count)
    value, count = value[used], count[used]
    ends = np.cumsum(count)
    first = np.concatenate([[0], np.cumsum(own)])[:-1]
    shift = np.repeat(start[:-1] - first, np.bincount(segment[used // 65], count, minlength=own.size).astype(np.int64))
    bit = (np.repeat(value, count) >> (np.repeat(ends, count) - 1 - np.arange(ends[-1])).astype(np.uint64)).astype(np.uint8) & 1
    line = np.ones(start[-1], np.uint8)
    line[np.arange(ends[-1]) + shift] = bit
    raw = np.packbits(line)
    full = raw == 0xFF
    of = np.repeat(np.arange(own.size), np.diff(start // 8))
    place = np.arange(raw.size) + np.cumsum(full) - full + 2 * of
    scan = np.zeros(raw.size + int(full.sum()) + 2 * (own.size - 1), np.uint8)
    scan[place] = raw
    border = place[(start[1:-1] // 8)] - 2
    scan[border], scan[border + 1] = 0xFF, 0xD0 + (interval + np.arange(own.size - 1)) % 8
    return (bytes([0xFF, 0xD0 + (interval - 1) % 8]) if interval else b"") + scan.tobytes()


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients are the payload's bytes; its length must be a positive multiple of 192.

    Restart intervals depend on nothing before them, so a long payload is coded in slices of bounded memory.
    """
    blocks = len(payload) // 64
    wide = int(np.ceil(np.sqrt(blocks)))
    high = -(-blocks // wide)
    if max(wide, high) > 8191:
        raise ValueError("payload beyond the largest JPEG")
    scans = []
    for lo in range(0, wide * high, SLICE):
        c = np.zeros((min(SLICE, wide * high - lo), 64), np.int64)
        own = np.frombuffer(payload, np.uint8)[64 * lo : 64 * (lo + SLICE)].reshape(-1, 64)
        c[: len(own)] = own.astype(np.int64) - ZERO_BYTE
        scans.append(_scan(c, lo // RESTART))
    head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % len(payload)) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += _segment(0xC4, b"\x00" + _DC[0] + _DC[1] + b"\x10" + _AC[0] + _AC[1]) + _segment(0xDD, RESTART.to_bytes(2, "big"))
    return head + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"".join(scans) + b"\xff\xd9"


@dataclass
class Scan:
    """Components of a scan with the Huffman tables of each, and its restart intervals' bytes and where each starts."""

    parts: list[tuple[int, tuple[bytes, bytes], tuple[bytes, bytes]]]
    restart: int
    raw: np.ndarray
    starts: np.ndarray


@dataclass
class Picture:
    """The parsed markers of a file and, once decoded, its coefficients in scan order."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    components: list[list[int]] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    coefficients: np.ndarray | None = None
    owner: np.ndarray | None = None

    def grid(self, k: int) -> tuple[int, int]:
        """Rows and columns of the blocks of component ``k`` in a scan of its own."""
        across, down = (max(c[x] for c in self.components) for x in (1, 2))
        return tuple(-(-(-(-n * self.components[k][x] // most)) // 8) for n, x, most in ((self.height, 2, down), (self.width, 1, across)))

    def layout(self, scan: Scan) -> tuple[list[int], int]:
        """Place in the scan's parts of each block of a coded unit, and the number of units."""
        if len(scan.parts) == 1:
            rows, columns = self.grid(scan.parts[0][0])
            return [0], rows * columns
        across, down = (max(c[x] for c in self.components) for x in (1, 2))
        return [j for j, (k, _, _) in enumerate(scan.parts) for _ in range(self.components[k][1] * self.components[k][2])], -(-self.width // (8 * across)) * -(-self.height // (8 * down))


def parse(data: bytes) -> Picture:
    """Markers and scans of a baseline file, one interleaved scan or several; others are refused."""
    try:
        return _parsed(data)
    except (IndexError, KeyError) as broken:
        raise ValueError("broken file") from broken


def _parsed(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, at = Picture(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 128 if wide else 64
                out.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else "u1").astype(np.int64)
                k += 1 + n
        elif marker == 0xC0 or marker == 0xC1:
            if body[0] != 8:
                raise ValueError("8-bit samples only")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(body[5])]
            if not out.components or len(out.components) > 4 or not (out.width and out.height) or any(not 1 <= x <= 4 for c in out.components for x in c[1:3]):
                raise ValueError("bad frame")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                out.huffman[body[k]] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in out.components]
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if any(c not in ids for c, _ in chosen):
                raise ValueError("scan of an unknown component")
            raw, starts, size = _intervals(np.frombuffer(data, np.uint8)[at:])
            out.scans.append(Scan([(ids.index(c), out.huffman[t >> 4], out.huffman[0x10 | t & 15]) for c, t in chosen], out.restart, raw, starts))
            at += size
    if sorted(k for s in out.scans for k, _, _ in s.parts) != list(range(len(out.components))) or not out.scans:
        raise ValueError("not one scan of each component")
    if any(c[3] not in out.quant for c in out.components):
        raise ValueError("no quantizer")
    return out


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16-bit peek; 0 for no code."""
    if (counts, symbols) not in _LOOKUPS:
        table, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for size in range(1, 17):
            for _ in range(counts[size - 1]):
                table[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_LOOKUPS) > 256:
            _LOOKUPS.clear()
        _LOOKUPS[counts, symbols] = table
    return _LOOKUPS[counts, symbols]


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The scan's bytes without stuffing and markers, where each restart interval starts in them, and the scan's size in the file."""
    full = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[full + 1]
    ends = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    stop = int(ends[0]) if ends.size else scan.size
    full, after = full[full < stop], after[full < stop]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.sort(np.concatenate([full[after == 0] + 1, marks, marks + 1]))
    keep = np.ones(stop, bool)
    keep[gone] = False
    return scan[:stop][keep], np.concatenate([[0], marks - np.searchsorted(gone, marks)]), stop


def decode_many(files: list[bytes]) -> list[Picture]:
    """Parse and entropy-decode baseline files; restart intervals of all of them are decoded side by side."""
    pictures = [parse(f) for f in files]
    tables: dict[tuple[bytes, bytes], int] = {}
    number = lambda spec: tables.setdefault(spec, len(tables))
    chunks, bit, base, blocks, layout_of, layouts, shapes = [], [], [], [], [], [], []
    held, made = 0, 0
    for p in pictures:
        for scan in p.scans:
            order, units = p.layout(scan)
            per = scan.restart or units
            n = -(-units // per)
            if scan.starts.size != n:
                raise ValueError("restart markers missing")
            chunks += [scan.raw, np.zeros(8, np.uint8)]
            bit.append((held + scan.starts) * 8)
            held += scan.raw.size + 8
            first = np.arange(n) * per
            base.append(made + first * len(order))
            blocks.append((np.minimum(first + per, units) - first) * len(order))
            shape = tuple((j, number(scan.parts[j][1]), number(scan.parts[j][2])) for j in order)
            if shape not in layouts:
                layouts.append(shape)
            layout_of.append(np.full(n, layouts.index(shape)))
            shapes.append((p, made, units * len(order), np.tile([scan.parts[j][0] for j in order], units)))
            made += units * len(order)
    if not pictures:
        return []
    longest = max(map(len, layouts))
    component, dc, ac = (np.array([[x[k] for x in s] + [0] * (longest - len(s)) for s in layouts]) for k in range(3))
    period = np.array([len(s) for s in layouts])
    lookup = np.concatenate([_lookup(*spec) for spec in tables])
    data = np.concatenate(chunks)
    eight = np.ndarray(data.size - 7, ">u8", data, strides=(1,))
    bit, base, blocks, kind = (np.concatenate(x).astype(np.int64) for x in (bit, base, blocks, layout_of))
    out = np.zeros((made, 64), np.int16)
    lane = np.arange(bit.size)
    predicted = np.zeros((bit.size, 4), np.int64)
    block, at = np.zeros(bit.size, np.int64), np.zeros(bit.size, np.int64)
    while lane.size:
        within = block % period[kind]
        first = at == 0
        table = np.where(first, dc[kind, within], ac[kind, within])
        word = (eight[bit >> 3] >> np.uint64(24)).astype(np.int64) << (bit & 7)
        found = lookup[(table << 16) + (word >> 24 & 0xFFFF)]
        if not found.all():
            raise ValueError("bad code")
        length, symbol = found >> 8, found & 255
        size = np.where(first, symbol, symbol & 15)
        extra = word >> (40 - length - size) & ((1 << size) - 1)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        bit = bit + length + size
        at = at + np.where(first, 0, symbol >> 4)
        which = component[kind, within]
        value = np.where(first, value + predicted[lane, which], value)
        predicted[lane[first], which[first]] = value[first]
        put = (first | (size > 0)) & (at < 64)
        out[base[put] + block[put], at[put]] = value[put]
        at = np.where(~first & (symbol == 0), 64, at + 1)
        over = at >= 64
        at[over] = 0
        block = block + over
        done = block >= blocks
        if done.any():
            go = ~done
            lane, bit, base, blocks, kind, block, at = (x[go] for x in (lane, bit, base, blocks, kind, block, at))
    for p in pictures:
        own = [(out[lo : lo + n], owner) for q, lo, n, owner in shapes if q is p]
        p.coefficients, p.owner = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*own, strict=True))
    return pictures


def decode_each(files: list[bytes | None]) -> list[Picture | None]:
    """``decode_many``, with None for a null and for a file that it refuses."""
    held = [k for k, f in enumerate(files) if f is not None]
    out: list[Picture | None] = [None] * len(files)
    try:
        for k, p in zip(held, decode_many([files[k] for k in held]), strict=True):
            out[k] = p
    except (ValueError, IndexError):
        if len(held) > 1:
            out = [decode_each([f])[0] for f in files]
    return out


def thumbnail(p: Picture) -> np.ndarray:
    """One luminance sample a block, from the DC coefficients."""
    c = p.components[0]
    dc = p.coefficients[p.owner == 0, 0].astype(np.int64) * int(p.quant[c[3]][0])
    if any(len(s.parts) == 1 and s.parts[0][0] == 0 for s in p.scans):
        grid = dc.reshape(p.grid(0))
    else:
        across, down = max(x[1] for x in p.components), max(x[2] for x in p.components)
        wide, high = -(-p.width // (8 * across)), -(-p.height // (8 * down))
        grid = dc.reshape(high, wide, c[2], c[1]).transpose(0, 2, 1, 3).reshape(high * c[2], wide * c[1])
    return np.clip((grid + 1028) // 8, 0, 255).astype(np.uint8)


def average_hash(grid: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail's 8 x 8 means exceed their mean."""
    rows, columns = (np.minimum(np.arange(n) * 8 // n, 7) for n in grid.shape)
    total, count = np.zeros((8, 8)), np.zeros((8, 8))
    np.add.at(total, (rows[:, None], columns[None, :]), grid)
    np.add.at(count, (rows[:, None], columns[None, :]), 1)
    mean = total / np.maximum(count, 1)
    return np.packbits((mean > mean.mean()).ravel()).tobytes().hex()


def payload_of(p: Picture) -> bytes | None:
    """The bytes that ``encode`` stored; None for a file that it didn't make."""
    said = p.comment.removeprefix(b"payload=")
    if said == p.comment or not said.isdigit():
        return None
    return (p.coefficients.ravel()[: int(said)] + ZERO_BYTE).astype(np.uint8).tobytes()


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (JPEG bytes) of whole texts; null counts as empty, equal texts give equal bytes."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, limit=2 << 20):
            raw = [t.encode() for t in common.texts_of(block)]
            media = [encode(r + b" " * (max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raw]
            yield pa.record_batch([block.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), stored, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored JPEG payloads: dimensions and thumbnail hash; every row of the input gets one.

    A file without a payload has its feature and no payload digests; a refused file has only its size and digest, a null nothing.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "media", limit=2 << 20):
            files = block.column("media").to_pylist()
            rows = []
            for data, p in zip(files, decode_each(files), strict=True):
                payload = payload_of(p) if p else None
                of_payload = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) if payload is not None else (None,) * 3
                of_file = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                rows.append((*of_payload, *of_file, f"{p.width}x{p.height}:{average_hash(thumbnail(p))}" if p else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([block.column("doc_id"), block.column("n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)

    return common.map_arrow(media, seen, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
