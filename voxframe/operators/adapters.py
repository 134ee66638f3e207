"""Subject-wise transforms over rows of (subject, key, is_label, shape, spacing, affine, data): what dictionary transforms do to a subject's files.

Each takes and gives a DataFrame, so it chains with ``DataFrame.transform``. Rows whose key is not among ``keys`` go through as they are.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, functions as F

from voxframe.errors import check_orientation, check_shape
from voxframe.operators import grid, sampling, subjects


def _only(df: DataFrame, keys: list | None, change) -> DataFrame:
    if keys is None:
        return change(df)
    return change(df.where(F.col("key").isin(keys))).unionByName(df.where(~F.coalesce(F.col("key").isin(keys), F.lit(False))))


def orientation(df: DataFrame, code: str, keys: list | None = None) -> DataFrame:
    """Each file turned to a three-letter code from its own affine."""
    return _only(df, keys, lambda d: grid.reorient(d, check_orientation(code)))


def resample(df: DataFrame, spacing: list[float] | None = None, size: list[int] | None = None, keys: list | None = None) -> DataFrame:
    """Each file to a spacing, labels by the nearest voxel; or to a size."""
    if size is not None:
        return _only(df, keys, lambda d: grid.resample_trilinear(d.where("NOT is_label"), size).unionByName(grid.resample_nearest(d.where("is_label"), size)))
    return _only(df, keys, lambda d: subjects.normalize(d, spacing))


def center_crop(df: DataFrame, size: list[int], keys: list | None = None, reference_key: int = 0) -> DataFrame:
    """The central box of the reference file, of all files."""
    return _only(df, keys, lambda d: subjects.coordinated_crop(d, check_shape(size), center=True, reference_key=reference_key))


def random_crop(df: DataFrame, size: list[int], seed: int = 42, keys: list | None = None, reference_key: int = 0) -> DataFrame:
    """One random box a subject, the same for its files."""
    return _only(df, keys, lambda d: subjects.coordinated_crop(d, check_shape(size), seed, reference_key=reference_key))


def label_aware_crops(df: DataFrame, size: list[int], count: int, label_key: int = 1, seed: int = 42, ratio: float = 1.0, least_positives: int = 1, background: float = 0.0) -> DataFrame:
    """``count`` boxes around the voxels of each subject's label file, of all its files: the rows of the files once for each k.

    A subject without a label file has no rows in the result.
    """
    label = df.where(F.col("key") == label_key).withColumn("vec_id", F.col("subject"))
    boxes = sampling.label_aware_regions(label, check_shape(size), count, seed, ratio, least_positives, background)
    boxes = boxes.select(F.col("vec_id").alias("subject"), "k", "positive", F.array("x0", "y0", "z0").alias("_start"), F.array("x1", "y1", "z1").alias("_stop"))
    return grid.crop(df.join(boxes, "subject"), *[[F.get(c, a) for a in range(3)] for c in ("_start", "_stop")]).drop("_start", "_stop")


def with_metadata(df: DataFrame) -> DataFrame:
    """The voxels beside one struct of what describes them."""
    held = [c for c in ("shape", "spacing", "affine", "dtype", "path") if c in df.columns]
    return df.withColumn("meta", F.struct(*held))


def file_name(path: str | Column, postfix: str = "trans", suffix: str = ".nii.gz") -> str | Column:
    """<stem>_<postfix><suffix> of a path; of a column of paths, an expression."""
    if isinstance(path, Column):
        stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?i)\.nii(\.gz|\.mgz)?$", "")
        return F.concat(stem, F.lit(f"_{postfix}{suffix}" if postfix else suffix))
    stem = posixpath.basename(path)
    for end in (".nii.gz", ".nii.mgz", ".nii"):
        if stem.lower().endswith(end):
            stem = stem[: -len(end)]
            break
    return stem + (f"_{postfix}{suffix}" if postfix else suffix)
