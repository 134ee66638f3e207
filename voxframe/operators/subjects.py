"""Several volumes of one subject: alignment by spacing, a common grid, a common crop.

Rows carry ``subject``, ``key`` (which of the subject's files), ``is_label``, ``shape``, ``spacing`` and ``data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxframe.functions.voxels import uniform
from voxframe.operators import grid


def _resampled(df: DataFrame, target: Column) -> DataFrame:
    """Every file at ``target``, labels by the nearest voxel, in one pass."""
    return grid.resample_to_spacing(df, target, F.when(F.col("is_label"), "nearest").otherwise("trilinear"))


def align(df: DataFrame, reference_key: int = 0) -> DataFrame:
    """Each file at the spacing of its subject's reference file, labels by the nearest voxel.

    A subject without that file has no rows in the result.
    """
    reference = df.where(F.col("key") == reference_key).select("subject", F.col("spacing").alias("_target"))
    return _resampled(df.join(reference, "subject"), F.col("_target")).drop("_target")


def normalize(df: DataFrame, spacing: list[float] | None = None, reference_key: int | None = None, orientation: str | None = None) -> DataFrame:
    """All files of a subject at one spacing: ``spacing``, that of the file ``reference_key``, or the least of the subject, axis by axis.

    With ``orientation``, a three-letter code, all are turned to it first, which needs an affine column.
    """
    if orientation is not None:
        df = grid.reorient(df, orientation)
    if spacing is not None:
        return _resampled(df, F.array(*map(F.lit, spacing)))
    if reference_key is not None:
        return align(df, reference_key)
    least = df.groupBy("subject").agg(*[F.min(F.get("spacing", k)).alias(f"_s{k}") for k in range(3)]).select("subject", F.array("_s0", "_s1", "_s2").alias("_target"))
    return _resampled(df.join(least, "subject"), F.col("_target")).drop("_target")


def coordinated_crop(df: DataFrame, size: list[int], seed: int = 42, center: bool = False, margin: int | None = None, reference_key: int = 0) -> DataFrame:
    """The same box for all files of a subject, that of its file ``reference_key``: the centre, or a start that is a hash of seed and subject.

    With ``margin`` a random start is at most that far from the central one along each axis. The box is cut to each
    volume; a subject without that file has no rows in the result.
    """
    starts = []
    for k, s in enumerate(size):
        last = F.greatest(F.get("shape", k) - s, F.lit(0))
        middle = F.floor(last / 2)
        low, high = (F.lit(0), last) if margin is None else (F.greatest(middle - margin, F.lit(0)), F.least(middle + margin, last))
        starts.append((middle if center else low + F.floor(uniform(seed, "crop", F.col("subject"), k) * (high - low + 1))).cast("int"))
    boxes = df.where(F.col("key") == reference_key).select("subject", F.array(*starts).alias("_start"))
    start = [F.get("_start", k) for k in range(3)]
    return grid.crop(df.join(boxes, "subject"), start, [b + s for b, s in zip(start, size, strict=True)]).drop("_start")
