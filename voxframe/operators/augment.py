"""Random augmentation whose randomness is a hash of (seed, operation, volume, voxel)."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxframe.functions.voxels import uniform
from voxframe.operators.grid import rotate_90
from voxframe.operators.volume import Kernel, each_volume


def _between(low: float, high: float, *keys: object) -> Column:
    return uniform(*keys) * F.lit(high - low) + F.lit(low)


def random_flip(df: DataFrame, seed: int, axes: tuple[int, ...] = (0, 1, 2), probability: float = 0.5) -> DataFrame:
    """Each listed axis is reversed with ``probability``."""
    turned = F.array(*[uniform(seed, "flip", F.col("vec_id"), k) < probability for k in axes])
    return each_volume(df, Kernel("random_flip", lambda v: replace(v, grid=np.flip(v.grid, [k for k, t in zip(axes, v.args["turned"], strict=True) if t]))), turned=turned)


def random_rotate_90(df: DataFrame, seed: int, axes: tuple[int, int] = (0, 1)) -> DataFrame:
    """0 to 3 quarter turns, each as likely."""
    return rotate_90(df, F.floor(uniform(seed, "rotate", F.col("vec_id")) * 4), axes)


def gaussian_noise(df: DataFrame, seed: int, std: float = 0.1) -> DataFrame:
    """Box-Muller noise on two uniforms of each voxel."""
    def noisy(v: Column, i: Column) -> Column:
        a, b = (uniform(seed, "noise", F.col("vec_id"), i, k) for k in (1, 2))
        return v + F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-10)))) * F.cos(b * (2 * math.pi)) * std

    return df.withColumn("data", F.transform("data", noisy))


def intensity_scale(df: DataFrame, seed: int, reach: float = 0.1) -> DataFrame:
    factor = 1 + _between(-reach, reach, seed, "scale", F.col("vec_id"))
    return df.withColumn("data", F.transform("data", lambda v: v * factor))


def intensity_shift(df: DataFrame, seed: int, reach: float = 0.1) -> DataFrame:
    offset = _between(-reach, reach, seed, "shift", F.col("vec_id"))
    return df.withColumn("data", F.transform("data", lambda v: v + offset))


def random_gamma(df: DataFrame, seed: int, low: float = 0.7, high: float = 1.5) -> DataFrame:
    power = _between(low, high, seed, "gamma", F.col("vec_id"))
    return df.withColumn("data", F.transform("data", lambda v: F.pow(F.greatest(v, F.lit(0.0)), power)))


@dataclass(frozen=True)
class RandomAugment:
    """Options of an augmentation; a step that is None is left out. Applied in the order flip, scale, shift, noise, gamma."""

    seed: int = 42
    flip_axes: tuple[int, ...] | None = (0, 1, 2)
    scale: float | None = 0.1
    shift: float | None = 0.1
    noise: float | None = 0.05
    gamma: tuple[float, float] | None = None

    def without(self, *steps: str) -> RandomAugment:
        """The same without the named options."""
        return replace(self, **dict.fromkeys(steps))

    def apply(self, df: DataFrame) -> DataFrame:
        if self.flip_axes is not None:
            df = random_flip(df, self.seed, self.flip_axes)
        if self.scale is not None:
            df = intensity_scale(df, self.seed, self.scale)
        if self.shift is not None:
            df = intensity_shift(df, self.seed, self.shift)
        if self.noise is not None:
            df = gaussian_noise(df, self.seed, self.noise)
        return df if self.gamma is None else random_gamma(df, self.seed, *self.gamma)


def random_augment(df: DataFrame, seed: int, noise: float = 0.05) -> DataFrame:
    """Flip, scale, shift and noise, in this order."""
    return RandomAugment(seed, noise=noise).apply(df)
