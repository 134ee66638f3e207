"""Training loaders: bounded iterators over patches and crops, in an order that a seed and an epoch fix.

The cluster reads, cuts and shuffles; ``toLocalIterator`` brings one partition at a time to the caller, the next one while it is
used, so memory on the driver is that of two partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F

from voxframe.errors import ValidationError, check_shape
from voxframe.functions.voxels import uniform
from voxframe.operators import sampling


@dataclass(frozen=True)
class PatchConfig:
    """Patches of ``shape``; ``per_volume`` of them, of the lattice with ``overlap`` first, or all random without ``lattice``."""

    shape: tuple[int, int, int] = (64, 64, 64)
    per_volume: int | None = 4
    overlap: int = 0
    lattice: bool = True

    def __post_init__(self) -> None:
        check_shape(self.shape)
        if self.per_volume is not None and self.per_volume < 1 or not 0 <= self.overlap < min(self.shape):
            raise ValidationError("per_volume must be positive and overlap less than the patch")


@dataclass
class LoaderStats:
    """What a loader has given out."""

    epoch: int = 0
    patches: int = 0
    batches: int = 0
    volumes: set = field(default_factory=set)


def batched(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    """Groups of ``size``; the last may be short."""
    while group := list(islice(rows, size)):
        yield group


def shuffled(df: DataFrame, seed: int, epoch: int, *keys: str) -> DataFrame:
    """Rows in the order of a hash of seed, epoch and keys: a range-partitioned sort."""
    return df.orderBy(uniform(seed, "epoch", epoch, *[F.col(k) for k in keys]), *keys)


class Loader:
    """Batches of the rows that ``make`` gives for an epoch; each row has vec_id, shape and data."""

    def __init__(self, make: Callable[[int], DataFrame], batch_size: int = 1, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        if batch_size < 1:
            raise ValidationError("batch_size must be positive")
        self.make, self.batch_size, self.transform, self.stats = make, batch_size, transform, LoaderStats()

    def __len__(self) -> int:
        """Batches of an epoch; counts the rows."""
        return -(-self.make(self.stats.epoch).count() // self.batch_size)

    def reset(self) -> Loader:
        """To the next epoch, with other random choices."""
        self.stats = LoaderStats(self.stats.epoch + 1)
        return self

    def __iter__(self) -> Iterator[list[tuple[Row, np.ndarray]]]:
        rows = self.make(self.stats.epoch).toLocalIterator(prefetchPartitions=True)
        for group in batched(iter(rows), self.batch_size):
            out = []
            for row in group:
                grid = np.array(row["data"]).reshape(row["shape"], order="F")
                out.append((row, self.transform(grid) if self.transform else grid))
                self.stats.volumes.add(row["vec_id"])
            self.stats.patches += len(out)
            self.stats.batches += 1
            yield out


def crop_loader(df: DataFrame, config: PatchConfig = PatchConfig(), seed: int = 42, batch_size: int = 1) -> Loader:
    """Patches volume by volume."""
    return Loader(lambda epoch: sampling.patches(df, list(config.shape), config.per_volume, seed + epoch, config.overlap, config.lattice), batch_size)


def training_loader(df: DataFrame, config: PatchConfig = PatchConfig(), seed: int = 42, batch_size: int = 1, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> Loader:
    """Exactly ``per_volume`` patches of each volume, all in a new order every epoch."""
    if config.per_volume is None:
        raise ValidationError("a training loader needs per_volume")
    return Loader(lambda epoch: shuffled(sampling.patches(df, list(config.shape), config.per_volume, seed + epoch, config.overlap, config.lattice), seed, epoch, "vec_id", "k"), batch_size, transform)


def fast_loader(df: DataFrame, shape: tuple[int, int, int] = (64, 64, 64), seed: int = 42, batch_size: int = 1, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> Loader:
    """One random crop of each volume, all in a new order every epoch."""
    check_shape(shape)
    return Loader(lambda epoch: shuffled(sampling.random_crop(df, list(shape), seed + epoch), seed, epoch, "vec_id"), batch_size, transform)
