"""Grid transforms of dense volumes as DataFrame functions; spacing and affine columns follow where the rows have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxframe.operators import volume
from voxframe.operators.volume import each_volume, size_for_spacing

__all__ = ["apply_affine", "center_crop", "crop", "crop_or_pad", "flip", "reorient", "resample_nearest", "resample_to_spacing", "resample_trilinear", "rotate_90", "size_for_spacing"]


def flip(df: DataFrame, axes: list[int]) -> DataFrame:
    """Reverse the listed axes; geometry columns stay as they are."""
    return each_volume(df, volume.flip(axes))


def rotate_90(df: DataFrame, turns: int | Column, axes: tuple[int, int] = (0, 1)) -> DataFrame:
    """``turns`` times: swap the two axes, then reverse the second of them."""
    if isinstance(turns, Column):
        return each_volume(df, volume.rotate_90(None, axes), turns=turns.cast("int"))
    return each_volume(df, volume.rotate_90(turns, axes))


def crop(df: DataFrame, start: list[int | Column], stop: list[int | Column]) -> DataFrame:
    """The box [start, stop), cut to the volume; a box outside it is empty. The affine's origin moves with it."""
    if any(isinstance(x, Column) for x in [*start, *stop]):
        ends = {n: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("int") for x in own]) for n, own in (("start", start), ("stop", stop))}
        return each_volume(df, volume.crop(), **ends)
    return each_volume(df, volume.crop(start, stop))


def center_crop(df: DataFrame, size: list[int]) -> DataFrame:
    return each_volume(df, volume.center_crop(size))


def crop_or_pad(df: DataFrame, size: list[int], fill: float = 0.0) -> DataFrame:
    """Centred: an axis too long loses floor(difference / 2) voxels in front, one too short gets as many."""
    return each_volume(df, volume.crop_or_pad(size, fill))


def reorient(df: DataFrame, target: str, source: str | None = None) -> DataFrame:
    """To a three-letter code, from the affine's own or ``source``: an axis permutation with flips."""
    return each_volume(df, volume.reorient(target, source))


def resample_nearest(df: DataFrame, size: list[int]) -> DataFrame:
    return each_volume(df, volume.resample_to_shape(size, "nearest"))


def resample_trilinear(df: DataFrame, size: list[int]) -> DataFrame:
    return each_volume(df, volume.resample_to_shape(size))


def resample_to_spacing(df: DataFrame, target: list[float] | Column, method: str | Column = "trilinear") -> DataFrame:
    """From each row's own spacing; a target or method that is a column may differ from row to row."""
    if not isinstance(target, Column) and not isinstance(method, Column):
        return each_volume(df, volume.resample_to_spacing(target, method))
    target = target if isinstance(target, Column) else F.array(*map(F.lit, target))
    return each_volume(df, volume.resample_to_spacing(None, None), target=target, method=method if isinstance(method, Column) else F.lit(method))


def apply_affine(df: DataFrame, matrix: list[list[float]], method: str = "trilinear") -> DataFrame:
    """Output voxel o takes the input at matrix * (o, 1); outside the volume it is 0."""
    return each_volume(df, volume.apply_affine(matrix, method))
