"""The method chain from path to path, arrays and tensors."""

import numpy as np
import pytest

from voxframe.operators import intensity
from voxframe.plans import frame
from voxframe.sources import arrays, files, nifti


def test_chain_from_path_to_path(spark, tmp_path):
    grid = np.arange(60.0).reshape(5, 4, 3)
    df = arrays.from_arrays(spark, [(1, grid, [1.0, 2.0, 3.0], None), (2, np.asfortranarray(grid) + 1, None, np.diag([-2.0, 1, 1, 1]))])
    files.save(df, str(tmp_path / "in"), dtype="float64").collect()
    chain = frame.load(spark, str(tmp_path / "in")).reorient("RAS").resample_to_shape([5, 4, 5]).clamp(0, 40).flip([0]).with_dtype("int16")
    assert len(chain) == 5 and "5 steps" in repr(chain) and not chain.is_materialized()
    assert chain.save(str(tmp_path / "out"), compression="gzip", dtype="int16") == 2
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.load(spark, str(tmp_path / "out")).collect()}
    assert sorted(out) == ["1.nii.gz", "2.nii.gz"] and all(r["shape"] == [5, 4, 5] for r in out.values())
    want = np.clip(grid[::-1][:, :, [0, 1, 2]], 0, 40)
    assert arrays.to_numpy(out["1.nii.gz"])[:, :, ::2].tolist() == want.tolist()
    kept = chain.materialize()
    assert kept.df.count() == 2 and kept.is_materialized()
    files.clear_cache(spark)


def test_arrays_and_tensors(spark):
    grid = np.arange(24.0).reshape(2, 3, 4)
    row = arrays.from_arrays(spark, [(7, grid, None, np.diag([3.0, 4.0, 5.0, 1.0]))]).first()
    assert arrays.to_numpy(row).tolist() == grid.tolist() and row["spacing"] == [3.0, 4.0, 5.0] and arrays.to_numpy(row, "int16").dtype == np.int16
    for library in ("torch", "jax"):
        if not arrays.available(library):
            with pytest.raises(ValueError):
                arrays.to_tensor(row, library)
    with pytest.raises(ValueError):
        arrays.to_tensor(row, "other")
    with pytest.raises(ValueError):
        arrays.from_arrays(spark, [(1, np.zeros((0, 2, 2)), None, None)])


@pytest.mark.parametrize("dtype", sorted({*intensity.RANGES, *intensity.FLOATS}))
def test_narrow_types_equal_numpy(spark, dtype):
    values = [0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 255.4, 1e5, -1e5, 3.14159, 65519.9, 65520.0, 1e-7, 6e-8, 1e30, -1e30, 2**40 + 0.5]
    got = intensity.with_dtype(spark.createDataFrame([(1, [len(values), 1, 1], values)], "vec_id long, shape array<int>, data array<double>"), dtype).first()["data"]
    if dtype in intensity.RANGES:
        lo, hi = intensity.RANGES[dtype]
        want = [float(min(max(int(abs(v) + 0.5) * (1 if v >= 0 else -1), lo), hi)) for v in values]
    elif dtype == "bfloat16":
        want = (nifti.to_bfloat16(np.array(values, "f4")).astype("<u4") << 16).view("<f4").astype(float).tolist()
    else:
        with np.errstate(over="ignore"):
            want = np.array(values).astype(dtype).astype(float).tolist()
    assert got == want
