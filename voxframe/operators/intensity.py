"""Voxel-wise maps and per-volume statistics.

Null voxels count as absent in statistics and stay null; an empty volume stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxframe.functions.voxels import let
from voxframe.operators import volume
from voxframe.operators.volume import each_volume


def moments(data: Column) -> Column:
    """struct(n, mean, variance) with the population variance E[v^2] - mean^2."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    total = F.aggregate(F.filter(data, lambda v: v.isNotNull()), start, lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    return let(total, lambda t: let(t["s"] / F.nullif(t["n"], F.lit(0.0)), lambda m: F.struct(t["n"].cast("long").alias("n"), m.alias("mean"), (t["q"] / F.nullif(t["n"], F.lit(0.0)) - m * m).alias("variance"))))


def z_normalize(df: DataFrame) -> DataFrame:
    """(v - mean) / std per volume; a variance of 0 or less divides by 1."""
    return each_volume(df, volume.z_normalize())


def rescale(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Minimum to ``low`` and maximum to ``high``; a constant volume becomes ``low``."""
    return each_volume(df, volume.rescale(low, high))


def clamp(df: DataFrame, low: float, high: float) -> DataFrame:
    return each_volume(df, volume.clamp(low, high))


def linear(df: DataFrame, slope: float, offset: float) -> DataFrame:
    """v * slope + offset; a stored slope of 0 means 1."""
    return each_volume(df, volume.linear(slope, offset))


def to_integer(df: DataFrame, low: int, high: int) -> DataFrame:
    """Round half away from zero and saturate."""
    return each_volume(df, volume.to_integer(low, high)).withColumn("data", F.col("data").cast("array<long>"))


#: Least and greatest value of each integer type.
RANGES = {f"{'u' * (lo == 0)}int{bits}": (lo, hi) for bits in (8, 16, 32, 64) for lo, hi in ((0, 2**bits - 1), (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1))}
#: Stored bits of the mantissa and the least exponent of each narrow float.
FLOATS = {"float16": (10, -14), "bfloat16": (7, -126), "float32": (23, -126)}


def with_dtype(df: DataFrame, dtype: str) -> DataFrame:
    """Voxels as a narrower type holds them: integers rounded half away from zero and saturated, floats to the nearest, even of two."""
    if dtype == "float64":
        return df
    if dtype in RANGES:
        return each_volume(df, volume.to_integer(*RANGES[dtype]))
    return each_volume(df, volume.narrowed(*FLOATS[dtype]))


def statistics(df: DataFrame) -> DataFrame:
    """n, v_min, v_max, v_mean and v_std of each volume."""
    return df.select("vec_id", moments(F.col("data")).alias("m"), F.array_min("data").alias("v_min"), F.array_max("data").alias("v_max")).select("vec_id", F.col("m.n").alias("n"), "v_min", "v_max", F.col("m.mean").alias("v_mean"), F.sqrt(F.greatest(F.col("m.variance"), F.lit(0.0))).alias("v_std"))
