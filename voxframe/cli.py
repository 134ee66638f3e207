"""Command line: ``python -m voxframe.cli convert-mgzip PATH... [-o FOLDER] [-r] [-w WORKERS] [--overwrite]``."""

from __future__ import annotations

import argparse
import glob
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from voxframe.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="voxframe")
    commands = out.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert-mgzip", help="rewrite volume files as independent gzip members")
    convert.add_argument("paths", nargs="+", help="files, folders or patterns")
    convert.add_argument("-o", "--output", help="folder of the new files; beside the old ones by default")
    convert.add_argument("-r", "--recursive", action="store_true", help="folders with all below them")
    convert.add_argument("-w", "--workers", type=int, default=os.cpu_count() or 1, help="tasks at a time where no cluster is set")
    convert.add_argument("--overwrite", action="store_true", help="replace files that are there already")
    info = commands.add_parser("info", help="print the headers of volume files")
    info.add_argument("paths", nargs="+")
    return out


def expanded(paths: Sequence[str], recursive: bool) -> list[str]:
    """Files of local patterns and folders; other paths as they are."""
    out: list[str] = []
    for p in paths:
        if "://" in p:
            out.append(p)
        elif os.path.isdir(p):
            out += [f for f in glob.glob(f"{p}/**" if recursive else f"{p}/*", recursive=recursive) if files.FILE_PATTERN.search(f)]
        else:
            out += glob.glob(p, recursive=recursive)
    return sorted(dict.fromkeys(os.path.abspath(p) if "://" not in p else p for p in out))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 where every file was converted or was there; 1 where no file was found."""
    options = parser().parse_args(arguments)
    paths = expanded(options.paths, getattr(options, "recursive", False))
    if not paths:
        print("no volume files found")
        return 1
    if spark is None:
        builder = SparkSession.builder.appName("voxframe")
        spark = (builder if os.environ.get("SPARK_REMOTE") or os.environ.get("MASTER") else builder.master(f"local[{getattr(options, 'workers', 1)}]")).getOrCreate()
    if options.command == "info":
        for r in files.info(files.load_header(spark, paths)).orderBy("path").toLocalIterator():
            print(f"{r['path']}: {'x'.join(map(str, r['shape']))} {r['dtype']} {r['orientation']} spacing {r['spacing']}")
        return 0
    for r in files.convert_to_mgzip(spark, paths, options.output, options.overwrite).toLocalIterator():
        print(f"{r['path']} -> {r['target']}" if r["written"] else f"{r['target']} is there")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
