"""Regions, patches and epochs over volumes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from voxframe.functions.voxels import div, uniform
from voxframe.operators import volume
from voxframe.operators.grid import crop
from voxframe.operators.volume import Volume, volume_rows


def voxels(df: DataFrame) -> DataFrame:
    """Long form: vec_id, i, x, y, z, v."""
    nx, ny = F.get("shape", 0), F.get("shape", 1)
    return df.select("vec_id", "shape", F.posexplode("data").alias("i", "v")).select("vec_id", "i", (F.col("i") % nx).alias("x"), (div(F.col("i"), nx) % ny).alias("y"), div(F.col("i"), nx * ny).alias("z"), "v")


def foreground_box(df: DataFrame, threshold: float, padding: int = 0, least_share: float = 0.0) -> DataFrame:
    """Bounding box of voxels above ``threshold``, grown by ``padding``; volumes without one, or with too small a share, are left out."""
    def box(v: Volume) -> list[tuple]:
        above = v.grid > threshold
        n = int(above.sum())
        if not n or n < least_share * v.grid.size:
            return []
        lines = [np.flatnonzero(above.any(axis=tuple(j for j in range(3) if j != k))) for k in range(3)]
        return [(n, *[max(int(x[0]) - padding, 0) for x in lines], *[min(int(x[-1]) + 1 + padding, d) for x, d in zip(lines, v.grid.shape, strict=True)])]

    return volume_rows(df, box, "n long, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")


def random_starts(df: DataFrame, size: list[int], count: int, seed: int) -> DataFrame:
    """``count`` boxes a volume, starts uniform over all that fit, the last included."""
    rows = df.select("vec_id", "shape", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    return rows.select("vec_id", "k", *[F.floor(uniform(seed, "box", F.col("vec_id"), F.col("k"), a) * (F.greatest(F.get("shape", a) - size[a], F.lit(0)) + 1)).cast("int").alias(f"{c}0") for a, c in enumerate("xyz")])


def grid_starts(df: DataFrame, size: list[int], overlap: int = 0) -> DataFrame:
    """Starts of all full patches of the lattice with step size - overlap."""
    out = df.select("vec_id", "shape")
    for a, c in enumerate("xyz"):
        last = F.get("shape", a) - size[a]
        out = out.where(last >= 0).withColumn(f"{c}0", F.explode(F.sequence(F.lit(0), last, F.lit(size[a] - overlap))))
    return out.drop("shape")


def patch_means(df: DataFrame, size: list[int]) -> DataFrame:
    """Mean of each full patch of a grid without overlap; one aggregate keyed by the patch of each voxel."""
    v = voxels(df).withColumns({f"{c}0": (div(F.col(c), s) * s).cast("int") for c, s in zip("xyz", size, strict=True)})
    whole = size[0] * size[1] * size[2]
    return v.groupBy("vec_id", "x0", "y0", "z0").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where(F.col("n") == whole).drop("n")


def region_around(center: tuple[int, ...], size: list[int], dims: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """start = max(0, c - size / 2), stop = min(start + size, dim): patches shrink at the high border."""
    start = [max(0, c - s // 2) for c, s in zip(center, size, strict=True)]
    return start, [min(a + s, d) for a, s, d in zip(start, size, dims, strict=True)]


def positives_of(count: int, ratio: float, least: int) -> int:
    """How many of ``count`` regions are centred on the label for ``ratio`` positives to one negative: at least ``least``, and the only one of one."""
    share = count * ratio / (1 + ratio)
    return min(count, max(math.ceil(share) if count == 1 else math.floor(share), least))


def label_aware_regions(df: DataFrame, size: list[int], count: int, seed: int = 42, ratio: float = 1.0, least_positives: int = 1, background: float = 0.0) -> DataFrame:
    """``count`` boxes of a label volume: vec_id, k, positive, x0, y0, z0, x1, y1, z1.

    The first are centred on voxels above ``background``, the others on the rest, each drawn with replacement by a hash of
    seed, volume and k. A volume all of one kind gives all boxes around that kind, but one without
    positives gives random boxes.
    """
    positives = positives_of(count, ratio, least_positives)
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    drawn = F.transform(numbers, lambda k: uniform(seed, "label", F.col("vec_id"), k))
    placed = F.transform(numbers, lambda k: F.array(*[uniform(seed, "box", F.col("vec_id"), k, a) for a in range(3)]))

    def regions(v: Volume) -> list[tuple]:
        flat = v.grid.ravel(order="F") > background
        kinds = {True: np.flatnonzero(flat), False: np.flatnonzero(~flat)}
        out = []
        for k in range(count if v.grid.size else 0):
            if not kinds[True].size:
                start = [int(u * (max(d - s, 0) + 1)) for u, d, s in zip(v.args["placed"][k], v.grid.shape, size, strict=True)]
                out.append((k, False, *start, *[min(a + s, d) for a, s, d in zip(start, size, v.grid.shape, strict=True)]))
                continue
            positive = k < positives or not kinds[False].size
            own = kinds[positive]
            start, stop = region_around(np.unravel_index(int(own[int(v.args["drawn"][k] * own.size)]), v.grid.shape, order="F"), size, v.grid.shape)
            out.append((k, positive, *map(int, start), *map(int, stop)))
        return out

    return volume_rows(df, regions, "k int, positive boolean, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int", drawn=drawn, placed=placed)


def lattice_of(dims: tuple[int, ...], size: list[int], overlap: int = 0) -> list[list[int]]:
    """Starts of all full patches with step size - overlap, x fastest."""
    axes = [range(0, d - s + 1, s - overlap) for d, s in zip(dims, size, strict=True)]
    return [[x, y, z] for z in axes[2] for y in axes[1] for x in axes[0]]


def patches(df: DataFrame, size: list[int], count: int | None = None, seed: int = 42, overlap: int = 0, lattice: bool = True, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The voxels of patches: ``keep``, k, x0, y0, z0, shape and data, and the moved affine where there is one.

    All patches of the lattice where ``count`` is None; else exactly ``count`` a volume, the lattice's first, topped up at
    random, or all random without ``lattice``. Each volume is read once; a patch beyond a small volume is cut.
    """
    numbers = F.sequence(F.lit(0), F.lit((count or 1) - 1))
    placed = F.transform(numbers, lambda k: F.array(*[uniform(seed, "box", F.col("vec_id"), k, a) for a in range(3)]))
    moved = "affine" in df.columns

    def cut(v: Volume) -> list[tuple]:
        starts = lattice_of(v.grid.shape, size, overlap) if lattice else []
        if count is not None:
            starts = starts[:count]
            starts += [[int(u * (max(d - s, 0) + 1)) for u, d, s in zip(own, v.grid.shape, size, strict=True)] for own in v.args["placed"][: count - len(starts)]]
        out = []
        for k, start in enumerate(starts):
            own = volume.crop(start, [a + s for a, s in zip(start, size, strict=True)]).run(v)
            out.append((k, *start, np.array(own.grid.shape), own.grid.ravel(order="F"), *([own.affine.ravel()] if moved and own.affine is not None else [None] * moved)))
        return out

    return volume_rows(df, cut, "k int, x0 int, y0 int, z0 int, shape array<int>, data array<double>" + ", affine array<double>" * moved, keep, placed=placed)


def random_crop(df: DataFrame, size: list[int], seed: int) -> DataFrame:
    """One random box of each volume, its other columns kept."""
    start = [F.floor(uniform(seed, "box", F.col("vec_id"), 0, k) * (F.greatest(F.get("shape", k) - s, F.lit(0)) + 1)).cast("int") for k, s in enumerate(size)]
    return crop(df, start, [a + s for a, s in zip(start, size, strict=True)])


def epoch(df: DataFrame, seed: int, number: int, part_rows: int = 1_000_000) -> DataFrame:
    """Volumes with their place in epoch ``number``: ordered by a hash of (seed, epoch, volume).

    The hash deals them to ranges of about ``part_rows`` rows, each sorted on its own; the places come from the ranges' sizes.
    The volumes are counted when this is called.
    """
    parts = max(64, -(-df.count() // part_rows))
    keyed = df.select("vec_id", uniform(seed, "epoch", number, F.col("vec_id")).alias("u"))
    part = F.floor(F.col("u") * parts).cast("int")
    keyed = keyed.withColumn("part", part)
    sizes = keyed.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    within = keyed.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("u", "vec_id")) - 1)
    return within.join(F.broadcast(before), "part").select("vec_id", (F.col("before") + F.col("k")).alias("place"))


def batches(ordered: DataFrame, size: int) -> DataFrame:
    """Batch number and place in it; the last batch may be short."""
    return ordered.select("vec_id", F.floor(F.col("place") / size).cast("long").alias("batch"), (F.col("place") % size).alias("slot"))


def exact_starts(df: DataFrame, size: list[int], count: int, seed: int) -> DataFrame:
    """Exactly ``count`` patches a volume: the lattice in order of z, y, x, cut or topped up at random."""
    lattice = grid_starts(df, size, 0)
    placed = lattice.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy("z0", "y0", "x0")) - 1).where(F.col("k") < count)
    found = lattice.groupBy("vec_id").agg(F.count("*").alias("n"))
    more = random_starts(df, size, count, seed).join(found, "vec_id", "left").where(F.col("k") + F.coalesce("n", F.lit(0)) < count)
    return placed.select("vec_id", "k", "x0", "y0", "z0").union(more.select("vec_id", (F.col("k") + F.coalesce("n", F.lit(0))).cast("int"), "x0", "y0", "z0"))
