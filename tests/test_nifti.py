"""The codec over all types, versions, byte orders and containers, and malformed headers."""

import struct

import numpy as np
import pytest

from voxframe.sources import nifti

SHAPE = [4, 3, 2]
VALUES = np.array([x + 10 * y + 100 * z for z in range(2) for y in range(3) for x in range(4)], float)


@pytest.mark.parametrize("dtype", sorted(nifti.CODES))
@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_roundtrip(dtype, version, order):
    raw = nifti.encode(VALUES, SHAPE, dtype, version=version, order=order, slope=2.0, inter=10.0)
    for content in (raw, nifti.members(raw), nifti.members(raw, chunk=100)):
        back = nifti.unpacked(content)
        head = nifti.parse(back)
        assert (head.version, head.order, head.shape, head.slope, head.inter) == (version, order, SHAPE, 2.0, 10.0)
        want = np.clip(VALUES, *((np.iinfo(nifti.DTYPES[head.code]).min, np.iinfo(nifti.DTYPES[head.code]).max) if nifti.DTYPES[head.code][0] in "iu" else (-np.inf, np.inf)))
        assert np.allclose(nifti.stored(head, back).astype(float), want, rtol=0.01)


@pytest.mark.parametrize(
    ("at", "value"),
    [(344, b"xxxx"), (70, struct.pack("<h", 32)), (72, struct.pack("<h", 7)), (40, struct.pack("<h", 9)), (42, struct.pack("<h", 0)), (80, struct.pack("<f", -1.0)), (108, struct.pack("<f", 10.0)), (348, b"\1")],
)
def test_malformed_headers_are_refused(at, value):
    raw = bytearray(nifti.encode(VALUES, SHAPE))
    raw[at : at + len(value)] = value
    with pytest.raises(ValueError):
        nifti.parse(bytes(raw))


def test_truncated_data_is_refused():
    raw = nifti.encode(VALUES, SHAPE)[:-1]
    with pytest.raises(ValueError):
        nifti.stored(nifti.parse(raw), raw)


def test_slope_zero_means_one():
    assert nifti.parse(nifti.encode(VALUES, SHAPE, slope=0.0)).slope == 1.0


def test_read_files(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(nifti.encode(VALUES, SHAPE, "int16"))
    (tmp_path / "b.nii.gz").write_bytes(nifti.members(nifti.encode(VALUES, SHAPE, "float64", version=2)))
    rows = nifti.read_nifti(spark, str(tmp_path)).orderBy("path").collect()
    assert [r["dtype"] for r in rows] == ["int16", "float64"]
    assert all(r["data"] == VALUES.tolist() for r in rows)
    box = nifti.read_nifti(spark, str(tmp_path), ([1, 0, 1], [3, 2, 9])).first()
    assert box["shape"] == [2, 2, 1] and box["data"] == [101, 102, 111, 112] and box["affine"][3] == 1.0
