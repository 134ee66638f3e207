"""Volume files by path: headers alone, boxes by seek, whole volumes, and sinks.

Files are listed by Spark. What is read of them is read by pyarrow's file systems in the tasks, so that a header costs a
few hundred bytes and a box of an uncompressed file the rows that it touches; a store that pyarrow doesn't know is read
whole through Spark's own file source. Gzip, several members included, is told by its magic, and is inflated only as far as needed.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import is_remote

from voxframe.errors import ConfigurationError
from voxframe.functions.voxels import uniform
from voxframe.operators import grid
from pyspark.sql.pandas.types import to_arrow_schema

from voxframe.sources import nifti

HEADER = "path string, version int, little_endian boolean, dtype string, shape array<int>, spacing array<double>, affine array<double>, slope double, inter double, gzipped boolean, mgzip boolean"
FILE_PATTERN = re.compile(r"\.nii(\.gz|\.mgz)?$", re.I)
#: Bytes that hold any header, and those in which a second gzip member shows.
HEAD_BYTES, MEMBER_BYTES = 544, 32 << 10
#: Bytes and files of a task on average, at most.
TASK_BYTES, TASK_FILES = 128 << 20, 1024
#: Tasks that go through a listing at most; Spark counts a file as 4 MB at least, and so has a task for every 32 small ones.
LISTING_TASKS = 64
#: Rows of a record batch at most, and bytes at which it is full.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def list_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(path, length) of the volume files under ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.col("path").rlike(f"(?i){FILE_PATTERN.pattern}")).select("path", "length")


def dealt(files: DataFrame, count: int, size: int) -> DataFrame:
    """Listed files, large and small alike, in as many tasks as their number, their bytes and the cores ask for; a task costs more than a hundred small files."""
    cores = LISTING_TASKS if is_remote() else files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-count // TASK_FILES), -(-size // TASK_BYTES), min(count, 3 * cores))
    # without a column between them, the optimizer drops the first of two changes of partitions
    return files.coalesce(LISTING_TASKS).withColumn("_at", F.monotonically_increasing_id()).repartition(tasks)


def batched(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches; one that is large ends its batch."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.types, strict=True)], names=kinds.names)

    for row in rows:
        own = sum(x.nbytes if isinstance(x, np.ndarray) else 64 for x in row)
        if held and size + own > BATCH_BYTES:
            yield made()
            held, size = [], 0
        held.append(row)
        size += own
        if size >= BATCH_BYTES or len(held) == BATCH_ROWS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class Bytes:
    """Bytes of a file by position; a compressed one is inflated from its start, no further than asked for."""

    def __init__(self, handle: pa.NativeFile) -> None:
        self.handle = handle
        self.head = handle.read_at(MEMBER_BYTES, 0)
        self.gzipped = self.head[:2] == b"\x1f\x8b"
        self.plain = bytearray()
        self.at = 0
        self.inflater = zlib.decompressobj(31)

    def read(self, start: int, size: int) -> bytes:
        if not self.gzipped:
            return self.handle.read_at(size, start)
        while len(self.plain) < start + size:
            raw = self.handle.read_at(1 << 20, self.at)
            if not raw:
                break
            self.at += len(raw)
            while raw:
                self.plain += self.inflater.decompress(raw)
                raw = self.inflater.unused_data
                if self.inflater.eof:
                    self.inflater = zlib.decompressobj(31)
        return bytes(self.plain[start : start + size])


def is_mgzip(head: bytes) -> bool:
    """A second gzip member starts within the first 32 KiB."""
    if head[:3] != b"\x1f\x8b\x08":
        return False
    inflater = zlib.decompressobj(31)
    try:
        inflater.decompress(head[:MEMBER_BYTES])
    except zlib.error:
        return False
    return inflater.eof and inflater.unused_data[:3] == b"\x1f\x8b\x08"


def header_row(path: str, data: Bytes) -> tuple:
    h = nifti.parse(data.read(0, HEAD_BYTES))
    return path, h.version, h.order == "<", nifti.NAMES[nifti.DTYPES[h.code]], h.shape, h.spacing, list(map(float, h.affine)), float(h.slope), float(h.inter), data.gzipped, is_mgzip(data.head)


def boxed(data: Bytes, start: list[int], stop: list[int]) -> tuple[nifti.Header, list[int], np.ndarray]:
    """Header, start and scaled voxels of a box, cut to the volume: one read for each run of rows along the first axis."""
    h = nifti.parse(data.read(0, HEAD_BYTES))
    dims = [*h.shape, 1, 1][: max(3, len(h.shape))]
    low = [min(max(a, 0), d) for a, d in zip([*start, *[0] * len(dims)], dims, strict=False)]
    high = [max(min(b, d), a) for a, b, d in zip(low, [*stop, *dims[len(stop) :]], dims, strict=True)]
    kind = nifti.DTYPES[h.code]
    wide = 2 if kind == "bf16" else np.dtype(kind).itemsize
    size = [b - a for a, b in zip(low, high, strict=True)]
    whole_rows = size[0] == dims[0]
    lines = []
    outer = [np.arange(a, b) for a, b in zip(low[2:], high[2:], strict=True)]
    for place in np.stack(np.meshgrid(*outer, indexing="ij"), axis=-1).reshape(-1, len(outer), order="F") if all(size) else []:
        plane = 0
        for d, x in zip(reversed(dims[2:]), reversed(place.tolist()), strict=True):
            plane = plane * d + x
        rows = [(low[1], size[1])] if whole_rows else [(y, 1) for y in range(low[1], high[1])]
        for y, n in rows:
            first = (plane * dims[1] + y) * dims[0] + low[0]
            want = (n * dims[0] if whole_rows else size[0]) * wide
            raw = data.read(h.offset + first * wide, want)
            if len(raw) < want:
                raise ValueError("file shorter than its data")
            lines.append(raw)
    values = nifti.numbers(kind, h.order, b"".join(lines)).astype(float) * h.slope + h.inter
    return h, low, values.reshape(size[: len(h.shape)], order="F")


def each_file(files: DataFrame, function: Callable[[str, Bytes, dict], tuple], schema: str) -> DataFrame:
    """One row of ``schema`` from each file of (path, length, ...); the function gets the path, its bytes and the row's other columns."""
    spark = files.sparkSession
    target = StructType.fromDDL(schema)
    kinds = to_arrow_schema(target)
    names = files.columns
    # a scheme that pyarrow can't open is read by Spark
    first, count, size = files.coalesce(LISTING_TASKS).agg(F.min("path"), F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    known = True
    if first is not None:
        try:
            opened(first)
        except (pa.ArrowInvalid, OSError):
            known = False
    if not known:
        content = spark.read.format("binaryFile").load([r["path"] for r in files.select("path").distinct().toLocalIterator()]).select("path", "content")
        files = files.join(content, "path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"]
                if known:
                    system, inner = opened(path)
                    with system.open_input_file(inner) as handle:
                        yield function(path, Bytes(handle), row)
                else:
                    yield function(path, Bytes(pa.PythonFile(pa.BufferReader(row["content"]))), row)

    files = dealt(files, count, size) if known else files.select(*names, "content")
    return files.mapInArrow(lambda batches: batched(rows(batches), kinds), target)


def load_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The header of each file, without its voxels."""
    return each_file(list_files(spark, path), lambda p, data, row: header_row(p, data), HEADER)


def info(headers: DataFrame) -> DataFrame:
    """path, shape, spacing, affine, orientation, dtype and the number of voxels and of bytes."""
    from voxframe.functions.geometry import orientation_code

    rows = F.array(*[F.slice("affine", 4 * r + 1, 4) for r in range(3)])
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, d: a * d)
    wide = F.coalesce(F.regexp_extract("dtype", r"(\d+)", 1).cast("int"), F.lit(0)) / 8
    return headers.select("path", "shape", "spacing", "affine", orientation_code(rows).alias("orientation"), "dtype", n.alias("num_voxels"), (n * wide).cast("long").alias("data_size"))


VOLUME = "path string, dtype string, shape array<int>, spacing array<double>, affine array<double>, data array<double>"


def _volume(path: str, data: Bytes, start: list[int], stop: list[int]) -> tuple:
    h, low, box = boxed(data, start, stop)
    affine = np.array(h.affine, float).reshape(3, 4)
    affine[:, 3] += affine[:, :3] @ np.array(low[:3], float)
    return path, nifti.NAMES[nifti.DTYPES[h.code]], list(box.shape), h.spacing, affine.ravel().tolist(), box.ravel(order="F")


def load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole volumes, their values scaled."""
    return each_file(list_files(spark, path), lambda p, data, row: _volume(p, data, [], []), VOLUME)


def load_cached(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``load``, kept by the executors in memory and on disk once it is read; the same files share one copy."""
    return load(spark, path).persist()


def clear_cache(spark: SparkSession) -> None:
    """Let go of all that is kept."""
    spark.catalog.clearCache()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one of ``spark.checkpoint.dir``, which the cluster shares; a temporary one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voxframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load_cropped(spark: SparkSession, path: str | list[str], offset: list[int], shape: list[int]) -> DataFrame:
    """The box of ``shape`` at ``offset``, cut to each volume; the affine's origin moves with it."""
    stop = [a + s for a, s in zip(offset, shape, strict=True)]
    return each_file(list_files(spark, path), lambda p, data, row: _volume(p, data, offset, stop), VOLUME)


def load_random_crop(spark: SparkSession, path: str | list[str], shape: list[int], seed: int = 42) -> DataFrame:
    """A box of ``shape`` from each file; where it starts is a hash of the seed and the file's name."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    files = list_files(spark, path).withColumn("u", F.array(*[uniform(seed, "box", name, k) for k in range(len(shape))]))

    def read(p: str, data: Bytes, row: dict) -> tuple:
        dims = nifti.parse(data.read(0, HEAD_BYTES)).shape
        start = [int(u * (max(d - s, 0) + 1)) for u, d, s in zip(row["u"], dims, shape, strict=False)]
        return _volume(p, data, start, [a + s for a, s in zip(start, shape, strict=True)])

    return each_file(files, read, VOLUME)


@dataclass(frozen=True)
class CropConfig:
    """What ``load_with_crop`` does; no offset means the centre, no spacing or orientation means the file's own."""

    shape: tuple[int, int, int] = (64, 64, 64)
    offset: tuple[int, int, int] | None = None
    spacing: tuple[float, float, float] | None = None
    orientation: str | None = None


def load_with_crop(spark: SparkSession, path: str | list[str], config: CropConfig = CropConfig()) -> DataFrame:
    """Cropped in the file's voxels, then reoriented, then resampled."""
    def read(p: str, data: Bytes, row: dict) -> tuple:
        dims = nifti.parse(data.read(0, HEAD_BYTES)).shape
        start = config.offset or [max(0, d - s) // 2 for d, s in zip(dims, config.shape, strict=False)]
        return _volume(p, data, list(start), [a + s for a, s in zip(start, config.shape, strict=False)])

    out = each_file(list_files(spark, path), read, VOLUME)
    if config.orientation is not None:
        out = grid.reorient(out, config.orientation)
    return out if config.spacing is None else grid.resample_to_spacing(out, list(config.spacing))


def load_resampled(spark: SparkSession, path: str | list[str], shape: list[int], spacing: list[float] | None = None, orientation: str | None = None) -> DataFrame:
    """``load_with_crop`` at the centre: ``shape`` is in the file's voxels, so the result has it only where the spacing stays."""
    return load_with_crop(spark, path, CropConfig(tuple(shape), None, tuple(spacing) if spacing else None, orientation))


SUFFIX = {"none": ".nii", "gzip": ".nii.gz", "mgzip": ".nii.mgz"}


def packed(raw: bytes, compression: str) -> bytes:
    return raw if compression == "none" else nifti.members(raw, len(raw) if compression == "gzip" else 1 << 20)


def put(path: str, raw: bytes, overwrite: bool) -> bool:
    """Write a file as a whole: under another name first, so that a lost task leaves none that is cut short. False where it is there already."""
    system, inner = opened(path)
    if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
        return False
    part = f"{posixpath.dirname(inner)}/.{posixpath.basename(inner)}.{uuid.uuid4().hex}"
    try:
        stream = system.open_output_stream(part)
    except FileNotFoundError:  # the first file of a folder
        system.create_dir(posixpath.dirname(inner), recursive=True)
        stream = system.open_output_stream(part)
    with stream as out:
        out.write(raw)
    system.move(part, inner)
    return True


def save(df: DataFrame, folder: str, name: str = "vec_id", compression: str = "none", dtype: str = "float32", overwrite: bool = True) -> DataFrame:
    """Write each volume as ``folder``/<name><suffix>; returns (path, bytes, written) when read, which is when the files are made.

    Repeated names end in one file, the last. Spacing and affine are written where the rows have them. Volumes beyond
    version 1 of the format are written as version 2.
    """
    if compression not in SUFFIX:
        raise ValueError(f"unknown compression {compression}")
    geometry = [c for c in ("spacing", "affine") if c in df.columns]
    schema = "path string, bytes long, written boolean"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from voxframe.operators.volume import arrays

        for batch in batches:
            for k, (own, shape, data) in enumerate(zip(batch.column("_name").to_pylist(), batch.column("shape").to_pylist(), arrays(batch.column("data")), strict=True)):
                how = {c: batch.column(c)[k].as_py() for c in geometry}
                raw = packed(nifti.encode(data, shape, dtype, version=2 if max(shape) > 32767 else 1, **how), compression)
                path = f"{folder.rstrip('/')}/{own}{SUFFIX[compression]}"
                yield path, len(raw), put(path, raw, overwrite)

    return df.select(F.col(name).cast("string").alias("_name"), "shape", "data", *geometry).mapInArrow(lambda batches: batched(write(batches), kinds), schema)


def convert_to_mgzip(spark: SparkSession, path: str | list[str], folder: str | None = None, overwrite: bool = False) -> DataFrame:
    """Each file again as independent gzip members, beside it or in ``folder``; one that is there already is left alone.

    Returns (path, target, bytes, written) when read, which is when the files are made.
    """
    def convert(p: str, data: Bytes, row: dict) -> tuple:
        raw = data.read(0, 1 << 62) if data.gzipped else data.read(0, row["length"])
        nifti.parse(raw[:HEAD_BYTES])
        name = FILE_PATTERN.sub("", posixpath.basename(p)) + SUFFIX["mgzip"]
        target = f"{(folder or posixpath.dirname(p)).rstrip('/')}/{name}"
        made = packed(raw, "mgzip")
        return p, target, len(made), put(target, made, overwrite)

    files = list_files(spark, path).where(~F.lower("path").endswith(SUFFIX["mgzip"]))
    return each_file(files, convert, "path string, target string, bytes long, written boolean")
