"""Numpy kernels over dense volumes in Arrow batches.

A volume is a row with ``shape`` (array of int) and ``data`` (axis 0 fastest), and perhaps ``spacing`` (three
doubles) and ``affine`` (twelve doubles, three rows of four). ``each_volume`` runs any number of kernels
over each row in one pass of the Python workers; other columns go through untouched. Rows are independent: no shuffle, and memory is
that of one Arrow batch of at most ``BATCH_BYTES`` or one volume. Null data stays null; null voxels become
not-a-number inside kernels and null again after them; an empty volume stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_BYTES = 64 << 20


@dataclass(frozen=True)
class Volume:
    """One row inside a kernel: its voxels by (x, y, z), its geometry if it has one, and the kernel's column arguments."""

    grid: np.ndarray
    spacing: np.ndarray | None = None
    affine: np.ndarray | None = None
    args: dict[str, object] | None = None

    def moved(self, grid: np.ndarray, start: list[float]) -> Volume:
        """A box of the same lattice whose first voxel was at ``start``."""
        affine = self.affine
        if affine is not None:
            affine = affine.copy()
            affine[:, 3] += affine[:, :3] @ np.asarray(start, float)
        return replace(self, grid=grid, affine=affine)

    def scaled(self, grid: np.ndarray, factor: list[float], spacing: list[float] | None = None) -> Volume:
        """Another lattice from the same corner, ``factor`` times as wide along each axis."""
        affine = self.affine
        if affine is not None:
            affine = affine.copy()
            affine[:, :3] *= np.asarray(factor, float)
        own = self.spacing if self.spacing is None else np.asarray(spacing, float) if spacing is not None else self.spacing * factor
        return replace(self, grid=grid, affine=affine, spacing=own)


@dataclass(frozen=True)
class Kernel:
    """A named function of one volume; ``linear`` holds slope and offset where it is no more than that."""

    name: str
    run: Callable[[Volume], Volume]
    linear: tuple[float, float] | None = None


def fused(kernels: list[Kernel]) -> list[Kernel]:
    """Neighbouring linear maps as one."""
    out: list[Kernel] = []
    for k in kernels:
        if out and k.linear and out[-1].linear:
            (s, o), (t, p) = out[-1].linear, k.linear
            out[-1] = linear(s * t, o * t + p)
        else:
            out.append(k)
    return out


def arrays(column: pa.Array) -> list[np.ndarray | None]:
    """A numpy view of each list of numbers, None for a null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    held = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], held, strict=True)]


def lists(rows: list[np.ndarray | None], kind: pa.DataType, null_values: bool = False) -> pa.Array:
    """The list column of ``kind`` of numpy rows."""
    sizes = [0 if r is None else r.size for r in rows]
    flat = np.concatenate([r for r in rows if r is not None]) if any(sizes) else np.zeros(0)
    values = pa.array(flat.astype(kind.value_type.to_pandas_dtype(), copy=False), kind.value_type, from_pandas=null_values)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=pa.array([r is None for r in rows])).cast(kind)


def each_volume(df: DataFrame, *kernels: Kernel, **args: Column) -> DataFrame:
    """``df`` with every volume put through ``kernels``; ``args`` are columns that kernels read by name."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names, steps, given = df.columns, fused(list(kernels)), list(args)
    geometry = [c for c in ("spacing", "affine") if c in names]
    wide = df.select("*", *[c.alias(f"_arg_{k}") for k, c in args.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {k: batch.column(f"_arg_{k}").to_pylist() for k in given}
            spacing, affine = (batch.column(c).to_pylist() if c in geometry else [None] * batch.num_rows for c in ("spacing", "affine"))
            nulls = batch.column("data").values.null_count > 0
            out: dict[str, list] = {c: [] for c in ("data", "shape", *geometry)}
            for k, (data, shape) in enumerate(zip(arrays(batch.column("data")), batch.column("shape").to_pylist(), strict=True)):
                if data is None or shape is None:
                    v = None
                else:
                    v = Volume(data.reshape(shape, order="F"), None if spacing[k] is None else np.asarray(spacing[k], float), None if affine[k] is None else np.asarray(affine[k], float).reshape(3, 4), {n: c[k] for n, c in own.items()})
                    for step in steps:
                        v = step.run(v)
                out["data"].append(None if v is None else v.grid.ravel(order="F"))
                out["shape"].append(shape if v is None else list(v.grid.shape))
                for c, held in (("spacing", spacing), ("affine", affine)):
                    if c in geometry:
                        out[c].append(held[k] if v is None or getattr(v, c) is None else getattr(v, c).ravel().tolist())
            made = {"data": lists(out["data"], batch.schema.field("data").type, nulls)} | {c: pa.array(out[c], batch.schema.field(c).type) for c in ("shape", *geometry)}
            yield pa.record_batch([made[c] if c in made else batch.column(c) for c in names], names=names)

    return wide.mapInArrow(run, df.schema)


def of(name: str, function: Callable[[Volume], Volume]) -> Kernel:
    return Kernel(name, function)


def z_normalize() -> Kernel:
    """(v - mean) / std with the population variance E[v^2] - mean^2; a variance of 0 or less divides by 1."""
    def run(v: Volume) -> Volume:
        held = v.grid[~np.isnan(v.grid)].astype(float) if np.isnan(v.grid).any() else v.grid.astype(float, copy=False).ravel(order="K")
        if not held.size:
            return v
        mean = held.mean()
        variance = (held * held).mean() - mean * mean
        return replace(v, grid=(v.grid - mean) / (np.sqrt(variance) if variance > 0 else 1.0))

    return of("z_normalize", run)


def rescale(low: float = 0.0, high: float = 1.0) -> Kernel:
    """Minimum to ``low`` and maximum to ``high``; a constant volume becomes ``low``."""
    def run(v: Volume) -> Volume:
        if not v.grid.size or np.isnan(v.grid).all():
            return v
        a, b = float(np.nanmin(v.grid)), float(np.nanmax(v.grid))
        return replace(v, grid=(v.grid.astype(float, copy=False) - a) / (b - a if b > a else 1.0) * (high - low) + low)

    return of("rescale", run)


def clamp(low: float, high: float) -> Kernel:
    return of("clamp", lambda v: replace(v, grid=np.clip(v.grid, low, high)))


def linear(slope: float, offset: float) -> Kernel:
    """v * slope + offset; a slope of 0 means 1."""
    slope = float(slope or 1.0)
    return Kernel("linear", lambda v: replace(v, grid=v.grid * slope + offset), (slope, float(offset)))


def flip(axes: list[int]) -> Kernel:
    """Reverse the listed axes; the geometry stays as it is."""
    return of("flip", lambda v: replace(v, grid=np.flip(v.grid, axes)))


def rotate_90(turns: int | None, axes: tuple[int, int] = (0, 1)) -> Kernel:
    """``turns`` times: swap the two axes, then reverse the second of them; None takes the argument ``turns``. The geometry stays."""
    def run(v: Volume) -> Volume:
        grid = v.grid
        for _ in range((v.args["turns"] if turns is None else turns) % 4):
            grid = np.flip(np.swapaxes(grid, *axes), axes[1])
        return replace(v, grid=grid)

    return of("rotate_90", run)


def crop(start: list[int] | None = None, stop: list[int] | None = None) -> Kernel:
    """The box [start, stop), cut to the volume, a box outside it is empty; None takes the arguments ``start`` and ``stop``."""
    def run(v: Volume) -> Volume:
        low = [min(max(s, 0), d) for s, d in zip(v.args["start"] if start is None else start, v.grid.shape, strict=True)]
        high = [max(min(s, d), a) for s, d, a in zip(v.args["stop"] if stop is None else stop, v.grid.shape, low, strict=True)]
        return v.moved(v.grid[tuple(slice(a, b) for a, b in zip(low, high, strict=True))], low)

    return of("crop", run)


def center_crop(size: list[int]) -> Kernel:
    def run(v: Volume) -> Volume:
        low = [max(d - s, 0) // 2 for d, s in zip(v.grid.shape, size, strict=True)]
        return crop(low, [a + s for a, s in zip(low, size, strict=True)]).run(v)

    return of("center_crop", run)


def crop_or_pad(size: list[int], fill: float = 0.0) -> Kernel:
    """Centred: an axis too long loses floor(difference / 2) voxels in front, one too short gets as many; the origin moves with them."""
    def run(v: Volume) -> Volume:
        shift = [(d - s) // 2 if d >= s else -((s - d) // 2) for d, s in zip(v.grid.shape, size, strict=True)]
        out = np.full(size, fill, v.grid.dtype, order="F")
        source = tuple(slice(max(a, 0), min(a + s, d)) for a, s, d in zip(shift, size, v.grid.shape, strict=True))
        target = tuple(slice(max(-a, 0), max(-a, 0) + part.stop - part.start) for a, part in zip(shift, source, strict=True))
        out[target] = v.grid[source]
        return v.moved(out, shift)

    return of("crop_or_pad", run)


#: World axis and direction of each letter.
AXES = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}


def code_of(affine: np.ndarray) -> str:
    """The orientation code of an affine: for each voxel axis the world axis of its largest component, the later of equal ones."""
    out = ""
    for k in range(3):
        size = np.abs(affine[:, k])
        r = k if size.max() < 1e-10 else 2 - int(np.argmax(size[::-1]))
        out += "RAS"[r] if size.max() < 1e-10 or affine[r, k] >= 0 else "LPI"[r]
    return out


def reorient(target: str, source: str | None = None) -> Kernel:
    """An axis permutation with flips to a three-letter code, from the affine's own or ``source``; the geometry follows."""
    wanted = [AXES[c] for c in target.upper()]

    def run(v: Volume) -> Volume:
        if source is None and v.affine is None:
            raise ValueError("a volume without an affine needs a source code")
        own = [AXES[c] for c in (source or code_of(v.affine)).upper()]
        order = [[a for a, _ in own].index(axis) for axis, _ in wanted]
        turned = [k for k, (f, (_, sign)) in enumerate(zip(order, wanted, strict=True)) if own[f][1] != sign]
        grid = np.flip(np.transpose(v.grid, order), turned)
        spacing, affine = v.spacing, v.affine
        if spacing is not None:
            spacing = spacing[order]
        if affine is not None:
            affine = np.concatenate([affine[:, order], affine[:, 3:]], axis=1)
            for k in turned:
                affine[:, 3] += affine[:, k] * (grid.shape[k] - 1)
                affine[:, k] *= -1
        return replace(v, grid=grid, spacing=spacing, affine=affine)

    return of("reorient", run)


def _nearest(grid: np.ndarray, size: list[int]) -> np.ndarray:
    """Half-pixel centres: source index floor((o + 0.5) * old / new), inside the volume."""
    at = [np.minimum(np.floor((np.arange(n) + 0.5) * d / n).astype(int), d - 1) for n, d in zip(size, grid.shape, strict=True)]
    return grid[np.ix_(*at)]


def _trilinear(grid: np.ndarray, size: list[int]) -> np.ndarray:
    """Aligned corners: position o * (old - 1) / (new - 1), 0 where new is 1. One axis at a time, those that shrink first."""
    grid = grid.astype(float, copy=False)
    for k in sorted(range(3), key=lambda k: size[k] / max(1, grid.shape[k])):
        old, new = grid.shape[k], size[k]
        if old == new:
            continue
        place = np.arange(new) * (old - 1) / (new - 1) if new > 1 else np.zeros(1)
        low = np.floor(place).astype(int)
        weight = (place - low).reshape([-1 if j == k else 1 for j in range(3)])
        a = np.take(grid, low, axis=k)
        grid = a + (np.take(grid, np.minimum(low + 1, old - 1), axis=k) - a) * weight
    return grid


def method_of(name: str) -> str:
    """``nearest`` or ``trilinear`` for a method's name or its short forms."""
    kinds = {"nearest": "nearest", "nn": "nearest", "trilinear": "trilinear", "linear": "trilinear"}
    if name.lower() not in kinds:
        raise ValueError(f"unknown interpolation {name}")
    return kinds[name.lower()]


def resampled(v: Volume, size: list[int], method: str, spacing: list[float] | None = None) -> Volume:
    """The volume on ``size`` voxels; its spacing becomes ``spacing``, or that of the same extent."""
    if not v.grid.size:
        return v
    grid = (_nearest if method_of(method) == "nearest" else _trilinear)(v.grid, size)
    factor = [d / n for d, n in zip(v.grid.shape, size, strict=True)] if spacing is None else np.asarray(spacing, float) / v.spacing
    return v.scaled(grid, factor, spacing)


def resample_to_shape(size: list[int] | None, method: str = "trilinear") -> Kernel:
    """None takes the argument ``size``."""
    return of("resample_to_shape", lambda v: resampled(v, v.args["size"] if size is None else size, method))


def size_for_spacing(shape: list[int], spacing: list[float], target: list[float]) -> list[int]:
    """max(1, round(dim * spacing / target)) for each axis, halves away from zero."""
    return [max(1, int(d * s / t + 0.5)) for d, s, t in zip(shape, spacing, target, strict=True)]


def resample_to_spacing(target: list[float] | None, method: str | None = "trilinear") -> Kernel:
    """To a spacing, from the volume's own; None takes the arguments ``target`` and ``method``."""
    def run(v: Volume) -> Volume:
        if v.spacing is None:
            raise ValueError("a volume without spacing can't be resampled to one")
        wanted = v.args["target"] if target is None else target
        return resampled(v, size_for_spacing(v.grid.shape, v.spacing, wanted), method or v.args["method"], wanted)

    return of("resample_to_spacing", run)


def apply_affine(matrix: list[list[float]], method: str = "trilinear") -> Kernel:
    """Output voxel o takes the input at matrix * (o, 1), 0 outside; the geometry stays. One slice at a time."""
    m, method = np.asarray(matrix, float), method_of(method)

    def run(v: Volume) -> Volume:
        out = np.zeros(v.grid.shape, float, order="F")
        last = np.array(v.grid.shape) - 1
        x, y = np.meshgrid(*map(np.arange, v.grid.shape[:2]), indexing="ij")
        for z in range(v.grid.shape[2]):
            place = np.stack([m[k, 0] * x + m[k, 1] * y + m[k, 2] * z + m[k, 3] for k in range(3)])
            if method == "nearest":
                at = np.trunc(place + np.copysign(0.5, place)).astype(int)
                inside = ((at >= 0) & (at <= last[:, None, None])).all(axis=0)
                out[inside, z] = v.grid[tuple(a[inside] for a in at)]
                continue
            inside = ((place >= 0) & (place <= last[:, None, None])).all(axis=0)
            p = place[:, inside]
            low = np.floor(p).astype(int)
            high, w = np.minimum(low + 1, last[:, None]), p - np.floor(p)
            total = np.zeros(p.shape[1])
            for corner in range(8):
                pick = [corner >> k & 1 for k in range(3)]
                total += v.grid[tuple((high if c else low)[k] for k, c in enumerate(pick))] * np.prod([w[k] if c else 1 - w[k] for k, c in enumerate(pick)], axis=0)
            out[inside, z] = total
        return replace(v, grid=out)

    return of("apply_affine", run)


def to_integer(low: int, high: int) -> Kernel:
    """Round half away from zero and saturate."""
    return of("to_integer", lambda v: replace(v, grid=np.clip(np.trunc(v.grid + np.copysign(0.5, v.grid)), low, high)))


def narrowed(bits: int, least: int) -> Kernel:
    """Rounded to ``bits`` stored bits of mantissa, even of two as near, with exponents from ``least``; what is beyond the range is infinite."""
    beyond = 2.0 ** (2 - least)

    def run(v: Volume) -> Volume:
        x = v.grid.astype(float, copy=False)
        unit = np.ldexp(1.0, np.maximum(np.frexp(x)[1] - 1, least) - bits)
        out = np.rint(x / unit) * unit
        return replace(v, grid=np.where(np.abs(out) >= beyond, np.copysign(np.inf, out), out))

    return of("narrowed", run)


def volume_rows(df: DataFrame, function: Callable[[Volume], list[tuple]], schema: str, keep: tuple[str, ...] = ("vec_id",), **args: Column) -> DataFrame:
    """Any number of rows of ``schema`` from each volume, with the columns ``keep`` before them; rows of null volumes give none."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    given, geometry = list(args), [c for c in ("spacing", "affine") if c in df.columns]
    wide = df.select(*keep, *[c for c in ("shape", "data", *geometry) if c not in keep], *[c.alias(f"_arg_{k}") for k, c in args.items()])
    target = StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(schema).fields])
    kinds = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {k: batch.column(f"_arg_{k}").to_pylist() for k in given}
            spacing, affine = (batch.column(c).to_pylist() if c in geometry else [None] * batch.num_rows for c in ("spacing", "affine"))
            for k, (data, shape) in enumerate(zip(arrays(batch.column("data")), batch.column("shape").to_pylist(), strict=True)):
                if data is None or shape is None:
                    continue
                rows = function(Volume(data.reshape(shape, order="F"), None if spacing[k] is None else np.asarray(spacing[k], float), None if affine[k] is None else np.asarray(affine[k], float).reshape(3, 4), {n: c[k] for n, c in own.items()}))
                if not rows:
                    continue
                same = pa.array([k] * len(rows))
                made = [batch.column(c).take(same) for c in keep]
                for column, kind in zip(zip(*rows, strict=True), kinds.types[len(keep) :], strict=True):
                    made.append(lists(list(column), kind) if pa.types.is_list(kind) else pa.array(column, kind))
                yield pa.record_batch([m.cast(t) for m, t in zip(made, kinds.types, strict=True)], names=kinds.names)

    return wide.mapInArrow(run, target)
