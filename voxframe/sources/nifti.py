"""NIfTI-1 and NIfTI-2 files as rows: parse, read, sub-box read, encode and write.

Files are one row each with their header fields, ``shape`` and ``data`` (axis 0 fastest, stored values
times slope plus intercept). Gzip is recognised by its magic, several members included.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxframe.operators.volume import arrays

DTYPES = {2: "u1", 256: "i1", 4: "i2", 512: "u2", 8: "i4", 768: "u4", 1024: "i8", 1280: "u8", 16: "f4", 64: "f8", 16384: "f2", 16385: "bf16"}
NAMES = {"u1": "uint8", "i1": "int8", "i2": "int16", "u2": "uint16", "i4": "int32", "u4": "uint32", "i8": "int64", "u8": "uint64", "f4": "float32", "f8": "float64", "f2": "float16", "bf16": "bfloat16"}
CODES = {name: code for code, name in ((c, NAMES[k]) for c, k in DTYPES.items())}
SCHEMA = "path string, version int, little_endian boolean, dtype string, shape array<int>, spacing array<double>, affine array<double>, slope double, inter double, data array<double>"


@dataclass
class Header:
    """What both versions share."""

    version: int
    order: str
    shape: list[int]
    code: int
    spacing: list[float]
    offset: int
    slope: float
    inter: float
    affine: list[float]


def _affine(order: str, raw: bytes, version: int, spacing: list[float], qfac: float) -> list[float]:
    """The first three rows: sform if its code is positive, else qform, else the spacing on the diagonal."""
    if version == 1:
        qcode, scode = struct.unpack_from(order + "2h", raw, 252)
        quat = struct.unpack_from(order + "6f", raw, 256)
        rows = struct.unpack_from(order + "12f", raw, 280)
    else:
        qcode, scode = struct.unpack_from(order + "2i", raw, 344)
        quat = struct.unpack_from(order + "6d", raw, 352)
        rows = struct.unpack_from(order + "12d", raw, 400)
    if scode > 0:
        return list(map(float, rows))
    if qcode > 0:
        return qform_affine(quat[:3], quat[3:], spacing, qfac)
    s = [*spacing, 1.0, 1.0, 1.0][:3]
    return [s[0], 0, 0, 0, 0, s[1], 0, 0, 0, 0, s[2], 0]


def qform_affine(quatern: tuple, offset: tuple, spacing: list[float], qfac: float) -> list[float]:
    b, c, d = quatern
    a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
    sx, sy, sz = [*spacing, 1.0, 1.0, 1.0][:3]
    sz *= -1 if qfac < 0 else 1
    turn = [[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]]
    return [x for row, o in zip(turn, offset, strict=True) for x in (row[0] * sx, row[1] * sy, row[2] * sz, float(o))]


def parse(raw: bytes) -> Header:
    """The header of either version in either byte order; ValueError says what is wrong with it."""
    for order in "<>":
        size = struct.unpack_from(order + "i", raw)[0] if len(raw) >= 4 else 0
        if size == 348 and len(raw) >= 348:
            if raw[344:348] not in (b"n+1\0", b"ni1\0"):
                raise ValueError("bad magic")
            dims = struct.unpack_from(order + "8h", raw, 40)
            code, bits = struct.unpack_from(order + "2h", raw, 70)
            pixdim = struct.unpack_from(order + "8f", raw, 76)
            offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
            version = 1
        elif size == 540 and len(raw) >= 540:
            if raw[4:7] not in (b"n+2", b"ni2"):
                raise ValueError("bad magic")
            code, bits = struct.unpack_from(order + "2h", raw, 12)
            dims = struct.unpack_from(order + "8q", raw, 16)
            pixdim = struct.unpack_from(order + "8d", raw, 104)
            offset, = struct.unpack_from(order + "q", raw, 168)
            slope, inter = struct.unpack_from(order + "2d", raw, 176)
            version = 2
        else:
            continue
        if not 1 <= dims[0] <= 7 or any(d < 1 for d in dims[1 : dims[0] + 1]):
            raise ValueError("bad dimensions")
        if code not in DTYPES:
            raise ValueError("unsupported data type")
        wide = 2 if DTYPES[code] == "bf16" else np.dtype(DTYPES[code]).itemsize
        if bits != 8 * wide:
            raise ValueError("bits don't match the data type")
        spacing = [float(p) for p in pixdim[1 : dims[0] + 1]]
        if any(not np.isfinite(p) or p <= 0 for p in spacing):
            raise ValueError("bad spacing")
        if not np.isfinite(offset) or offset != int(offset) or offset < size:
            raise ValueError("bad offset")
        if len(raw) > size and raw[size : size + 1] not in (b"", b"\0"):
            raise ValueError("extensions are not supported")
        return Header(version, order, list(dims[1 : dims[0] + 1]), code, spacing, int(offset), slope if np.isfinite(slope) and slope != 0 else 1.0, inter if np.isfinite(inter) else 0.0, _affine(order, raw, version, spacing, pixdim[0]))
    raise ValueError("no NIfTI header")


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def numbers(kind: str, order: str, raw: bytes) -> np.ndarray:
    """Stored values of a type and byte order."""
    if kind == "bf16":
        return (np.frombuffer(raw, order + "u2").astype("<u4") << 16).view("<f4")
    return np.frombuffer(raw, order + kind)


def stored(header: Header, raw: bytes) -> np.ndarray:
    """Stored values in file order."""
    kind = DTYPES[header.code]
    wide = 2 if kind == "bf16" else np.dtype(kind).itemsize
    n = int(np.prod(header.shape, dtype=object))
    if len(raw) < header.offset + n * wide:
        raise ValueError("file shorter than its data")
    return numbers(kind, header.order, memoryview(raw)[header.offset : header.offset + n * wide])


def to_bfloat16(values: np.ndarray) -> np.ndarray:
    """Upper 16 bits, rounded to nearest even; not-a-number stays so."""
    bits = np.ascontiguousarray(values, "<f4").view("<u4").astype("u8")
    out = ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2")
    return np.where(np.isnan(values), np.uint16(0x7FC0), out)


def encode(data: np.ndarray, shape: list[int], dtype: str = "float32", spacing: list[float] | None = None, affine: list[float] | None = None, version: int = 1, order: str = "<", slope: float = 1.0, inter: float = 0.0) -> bytes:
    """A whole file; ``data`` holds stored values, axis 0 fastest. Integers are rounded and saturated."""
    code = CODES[dtype]
    kind = DTYPES[code]
    if version == 1 and max(shape) > 32767:
        raise ValueError("an axis beyond 32767 needs version 2")
    spacing = [*(spacing or []), *[1.0] * 7][: len(shape)]
    affine = affine or [spacing[0], 0, 0, 0, 0, [*spacing, 1, 1][1], 0, 0, 0, 0, [*spacing, 1, 1][2], 0]
    dims = [len(shape), *shape, *[1] * 7][:8]
    pixdim = [1.0, *spacing, *[1.0] * 7][:8]
    if kind == "bf16":
        body, wide = to_bfloat16(np.asarray(data, float).astype("f4")).astype(order + "u2").tobytes(), 2
    else:
        wide = np.dtype(kind).itemsize
        values = np.asarray(data)
        if kind[0] in "iu":
            ends = np.iinfo(kind)
            values = np.clip(np.trunc(values + np.copysign(0.5, values)) if values.dtype.kind == "f" else values, ends.min, ends.max)
        body = values.astype(order + kind).tobytes()
    if version == 1:
        head = bytearray(352)
        struct.pack_into(order + "i", head, 0, 348)
        struct.pack_into(order + "8h", head, 40, *dims)
        struct.pack_into(order + "2h", head, 70, code, 8 * wide)
        struct.pack_into(order + "8f", head, 76, *pixdim)
        struct.pack_into(order + "3f", head, 108, 352, slope, inter)
        struct.pack_into(order + "2h", head, 252, 0, 1)
        struct.pack_into(order + "12f", head, 280, *affine)
        head[344:348] = b"n+1\0"
    else:
        head = bytearray(544)
        struct.pack_into(order + "i", head, 0, 540)
        head[4:12] = b"n+2\0\r\n\x1a\n"
        struct.pack_into(order + "2h", head, 12, code, 8 * wide)
        struct.pack_into(order + "8q", head, 16, *dims)
        struct.pack_into(order + "8d", head, 104, *pixdim)
        struct.pack_into(order + "q2d", head, 168, 544, slope, inter)
        struct.pack_into(order + "2i", head, 344, 0, 1)
        struct.pack_into(order + "12d", head, 400, *affine)
    return bytes(head) + body


def members(content: bytes, chunk: int = 1 << 20, level: int = 1) -> bytes:
    """Gzip in independent members, which readers may inflate in parallel."""
    return b"".join(gzip.compress(content[k : k + chunk], level, mtime=0) for k in range(0, max(1, len(content)), chunk))


def decoded(files: DataFrame, box: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Rows of (path, content) as volumes; ``box`` (start, stop) keeps a sub-box and moves the affine's origin. Malformed files raise."""

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                raw = unpacked(content)
                h = parse(raw)
                values, shape, affine = stored(h, raw), h.shape, h.affine
                if box is not None:
                    lo = [min(max(a, 0), d) for a, d in zip(box[0], shape, strict=False)]
                    hi = [max(min(b, d), a) for a, b, d in zip(lo, box[1], shape, strict=False)]
                    grid = values.reshape(shape, order="F")[tuple(slice(a, b) for a, b in zip(lo, hi, strict=True))]
                    shape, values = list(grid.shape), grid.ravel(order="F")
                    affine = [*affine]
                    for r in range(3):
                        affine[4 * r + 3] += sum(affine[4 * r + k] * lo[k] for k in range(min(3, len(lo))))
                values = values.astype(float) * h.slope + h.inter
                row = (path, h.version, h.order == "<", NAMES[DTYPES[h.code]], shape, h.spacing, list(map(float, affine)), float(h.slope), float(h.inter), values)
                yield pa.record_batch([pa.array([c], t) for c, t in zip(row, kinds.types, strict=True)], names=kinds.names)

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def read_nifti(spark: SparkSession, path: str, box: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Volumes of all files under ``path``, read through the engine's file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decoded(files, box)


def encoded(df: DataFrame, dtype: str = "float32", version: int = 1, compressed: bool = False) -> DataFrame:
    """(vec_id, content) of rows (vec_id, shape, data)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode(d, s, dtype, version=version) for s, d in zip(batch.column("shape").to_pylist(), arrays(batch.column("data")), strict=True)]
            yield pa.record_batch([batch.column("vec_id"), pa.array([members(f) if compressed else f for f in files], pa.binary())], names=["vec_id", "content"])

    return df.select("vec_id", "shape", "data").mapInArrow(write, "vec_id long, content binary")
