"""``spark.read.format("nifti")`` and ``df.write.format("nifti")``.

Reader options: ``what`` is ``volume`` (default) or ``header``; ``start`` and ``stop``, three comma-separated numbers each, keep a box.
Writer options: ``name`` (column of the file names, default vec_id), ``compression`` (none, gzip, mgzip) and ``dtype``.
Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxframe.sources import files, nifti

#: Files of one task, and bytes of them, at most.
TASK_FILES, TASK_BYTES = 256, 128 << 20


@dataclass
class Some(InputPartition):
    """The files of one task."""

    paths: list[str]


@dataclass
class Done(WriterCommitMessage):
    """How many files a task wrote."""

    files: int


def _numbers(text: str | None) -> list[int]:
    return [int(x) for x in text.split(",")] if text else []


class Reader(DataSourceReader):
    """One task for a run of neighbouring files; a task reads headers, boxes or whole volumes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.what = options["path"], options.get("what", "volume")
        self.start, self.stop = _numbers(options.get("start")), _numbers(options.get("stop"))
        if self.what not in ("volume", "header"):
            raise ValueError(f"unknown option what={self.what}")

    def partitions(self) -> list[Some]:
        system, inner = files.opened(self.path)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if system.get_file_info(inner).type == fs.FileType.Directory else [system.get_file_info(inner)]
        out, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and files.FILE_PATTERN.search(f.path)), key=lambda f: f.path):
            if not out or len(out[-1].paths) >= TASK_FILES or held + f.size > TASK_BYTES:
                out.append(Some([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Some) -> Iterator[tuple]:
        system, _ = files.opened(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as handle:
                data = files.Bytes(handle)
                if self.what == "header":
                    yield files.header_row(path, data)
                else:
                    row = files._volume(path, data, self.start, self.stop)
                    yield (*row[:-1], row[-1].tolist())


class Writer(DataSourceWriter):
    """One file a row, each moved into place once it is whole, so that a task that runs again does no harm."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.name, self.compression, self.dtype = options.get("name", "vec_id"), options.get("compression", "none"), options.get("dtype", "float32")
        if self.compression not in files.SUFFIX or self.dtype not in nifti.CODES:
            raise ValueError("unknown compression or dtype")

    def write(self, rows: Iterator[Row]) -> Done:
        n = 0
        for row in rows:
            how = {c: list(row[c]) for c in ("spacing", "affine") if c in row and row[c] is not None}
            raw = nifti.encode(np.array(row["data"], float), list(row["shape"]), self.dtype, version=2 if max(row["shape"]) > 32767 else 1, **how)
            n += files.put(f"{self.path.rstrip('/')}/{row[self.name]}{files.SUFFIX[self.compression]}", files.packed(raw, self.compression), self.overwrite)
        return Done(n)


class NiftiSource(DataSource):
    """The source itself."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return files.HEADER if self.options.get("what") == "header" else files.VOLUME

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NiftiSource)
