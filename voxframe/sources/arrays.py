"""The boundary to numpy and tensor libraries: a row from an array, an array or a tensor from a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession

from voxframe.errors import ConfigurationError, ValidationError, check_device

SCHEMA = "vec_id long, shape array<int>, spacing array<double>, affine array<double>, data array<double>"


def from_arrays(spark: SparkSession, arrays: Iterable[tuple[int, np.ndarray, Sequence[float] | None, np.ndarray | None]]) -> DataFrame:
    """Volumes of (id, array by (x, y, z), spacing, affine of 3 x 4 or 4 x 4) in either memory order.

    No spacing is that of the affine, or 1; no affine has the spacing on its diagonal.
    """
    rows = []
    for vec_id, grid, spacing, affine in arrays:
        if grid.ndim < 1 or not grid.size:
            raise ValidationError("an empty array is no volume")
        m = None if affine is None else np.asarray(affine, float)[:3, :4]
        own = [1.0] * 3 if spacing is None and m is None else np.linalg.norm(m[:, :3], axis=0).tolist() if spacing is None else [float(s) for s in spacing]
        m = np.concatenate([np.diag(own), np.zeros((3, 1))], axis=1) if m is None else m
        rows.append((int(vec_id), list(grid.shape), own, m.ravel().tolist(), grid.astype(float).ravel(order="F").tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def to_numpy(row: Row, dtype: str | None = None) -> np.ndarray:
    """A row's voxels by (x, y, z)."""
    out = np.array(row["data"], float).reshape(row["shape"], order="F")
    return out if dtype is None else out.astype(dtype)


def available(library: str) -> bool:
    """Whether torch, jax or another library can be imported here."""
    from importlib.util import find_spec

    return find_spec(library) is not None


def to_tensor(row: Row, library: str = "torch", dtype: str = "float32", device: str = "cpu") -> Any:
    """A row's voxels as a tensor of torch or jax, where the library is there."""
    if library not in ("torch", "jax"):
        raise ConfigurationError(f"unknown library {library!r}")
    check_device(device)
    if library == "torch" and dtype in ("uint16", "uint32", "uint64"):
        raise ConfigurationError(f"torch has no {dtype}")
    if not available(library):
        raise ConfigurationError(f"{library} is not installed", ["use to_numpy"])
    grid = np.ascontiguousarray(to_numpy(row, dtype))
    if library == "torch":
        import torch

        return torch.from_numpy(grid).to(device)
    import jax

    return jax.device_put(grid, jax.devices(device.partition(":")[0])[0])
