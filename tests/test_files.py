"""Files by path: headers, boxes by seek, crops, sinks and conversion."""

import gzip

import numpy as np
import pytest

from voxframe.sources import files, nifti

SHAPE = [7, 5, 6]
VALUES = np.array([x + 10 * y + 100 * z for z in range(6) for y in range(5) for x in range(7)], float)
GRID = VALUES.reshape(SHAPE, order="F")
AFFINE = [-1.0, 0.0, 0.0, 10.0, 0.0, -1.0, 0.0, 20.0, 0.0, 0.0, 2.5, 30.0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("nifti")
    raw = nifti.encode(VALUES, SHAPE, "int16", [1, 1, 2.5], AFFINE, slope=2.0, inter=10.0)
    (at / "a.nii").write_bytes(raw)
    (at / "b.nii.gz").write_bytes(gzip.compress(raw))
    (at / "sub").mkdir()
    (at / "sub" / "c.nii.mgz").write_bytes(nifti.members(nifti.encode(VALUES, SHAPE, "float64", [1, 1, 2.5], AFFINE, version=2, order=">"), chunk=300))
    (at / "notes.txt").write_text("no volume")
    return str(at)


def by_name(df):
    return {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_headers_alone(spark, folder):
    rows = by_name(files.load_header(spark, folder))
    assert {k: (r["dtype"], r["version"], r["little_endian"], r["gzipped"], r["mgzip"]) for k, r in rows.items()} == {"a.nii": ("int16", 1, True, False, False), "b.nii.gz": ("int16", 1, True, True, False), "c.nii.mgz": ("float64", 2, False, True, True)}
    facts = by_name(files.info(files.load_header(spark, folder)))
    assert all((r["orientation"], r["shape"], r["num_voxels"]) == ("LPS", SHAPE, 210) for r in facts.values())
    assert facts["a.nii"]["data_size"] == 420 and facts["c.nii.mgz"]["data_size"] == 1680


def test_whole_volumes_and_boxes(spark, folder):
    scale = {"a.nii": (2, 10), "b.nii.gz": (2, 10), "c.nii.mgz": (1, 0)}
    for k, r in by_name(files.load(spark, folder)).items():
        assert r["shape"] == SHAPE and r["data"] == (VALUES * scale[k][0] + scale[k][1]).tolist() and r["affine"] == AFFINE
    for offset, size in (([1, 2, 3], [3, 2, 2]), ([0, 1, 2], [7, 3, 9]), ([9, 0, 0], [2, 2, 2])):
        for k, r in by_name(files.load_cropped(spark, folder, offset, size)).items():
            box = GRID[tuple(slice(a, a + s) for a, s in zip(offset, size, strict=True))]
            assert r["shape"] == list(box.shape) and r["data"] == (box * scale[k][0] + scale[k][1]).ravel(order="F").tolist()
            assert r["affine"][3::4] == [10 - min(offset[0], 7), 20 - offset[1], 30 + 2.5 * offset[2]]


def test_a_box_reads_few_bytes(folder):
    import pyarrow as pa

    class Counted(files.Bytes):
        asked = 0

        def read(self, start, size):
            Counted.asked += size
            return super().read(start, size)

    with pa.OSFile(f"{folder}/a.nii") as handle:
        files.boxed(Counted(handle), [1, 1, 1], [3, 3, 3])
    assert Counted.asked == files.HEAD_BYTES + 4 * 2 * 2


def test_crop_then_reorient_then_resample(spark, folder):
    row = by_name(files.load_with_crop(spark, folder, files.CropConfig((4, 4, 4), None, (1.0, 1.0, 1.0), "RAS")))["a.nii"]
    assert row["shape"] == [4, 4, 10] and row["spacing"] == [1.0, 1.0, 1.0] and row["affine"][0] == 1.0
    box = GRID[1:5, 0:4, 1:5][::-1, ::-1] * 2 + 10
    assert np.array(row["data"]).reshape(4, 4, 10, order="F")[:, :, 0].tolist() == box[:, :, 0].tolist()
    assert by_name(files.load_resampled(spark, folder, [2, 2, 2]))["a.nii"]["shape"] == [2, 2, 2]


def test_random_crops_are_boxes_of_the_volume(spark, folder):
    first = by_name(files.load_random_crop(spark, folder, [3, 3, 3], 5))
    assert {k: r["data"] for k, r in first.items()} == {k: r["data"] for k, r in by_name(files.load_random_crop(spark, folder, [3, 3, 3], 5)).items()}
    for r in first.values():
        start = [round((r["affine"][3] - 10) / -1), round((r["affine"][7] - 20) / -1), round((r["affine"][11] - 30) / 2.5)]
        box = GRID[tuple(slice(a, a + 3) for a in start)].ravel(order="F")
        assert r["data"] in ((box * 2 + 10).tolist(), box.tolist())


@pytest.mark.parametrize("compression", ["none", "gzip", "mgzip"])
def test_saved_files_are_read_again(spark, tmp_path, compression):
    rows = [(k, SHAPE, (VALUES * k).tolist(), [1.0, 1.0, 2.5], AFFINE) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, shape array<int>, data array<double>, spacing array<double>, affine array<double>")
    done = files.save(df, str(tmp_path), compression=compression, dtype="float64").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in done) == [f"{k}{files.SUFFIX[compression]}" for k in range(3)]
    back = by_name(files.load(spark, str(tmp_path)))
    assert {k: (r["data"], r["spacing"], r["affine"]) for k, r in back.items()} == {f"{k}{files.SUFFIX[compression]}": (d, s, a) for k, _, d, s, a in rows}
    assert not any(r["written"] for r in files.save(df, str(tmp_path), compression=compression, overwrite=False).collect())
    with pytest.raises(ValueError):
        files.save(df, str(tmp_path), compression="zip")


def test_conversion_to_members(spark, folder, tmp_path):
    done = files.convert_to_mgzip(spark, folder, str(tmp_path / "out")).collect()
    assert sorted(r["target"].rsplit("/", 1)[1] for r in done) == ["a.nii.mgz", "b.nii.mgz"] and all(r["written"] for r in done)
    assert not any(r["written"] for r in files.convert_to_mgzip(spark, folder, str(tmp_path / "out")).collect())
    want = by_name(files.load(spark, folder))["a.nii"]["data"]
    assert all(r["data"] == want for r in files.load(spark, str(tmp_path / "out")).collect())


def test_many_small_files_take_few_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    raw = nifti.encode(np.arange(8.0), [2, 2, 2], "uint8")
    for k in range(2000):
        (tmp_path / f"{k}.nii").write_bytes(raw)
    for most, tasks in ((1024, 12), (100, 20)):
        monkeypatch.setattr(files, "TASK_FILES", most)
        rows = files.load_header(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) == tasks and sum(r["count"] for r in rows) == 2000 and max(r["count"] for r in rows) < 1.5 * 2000 / tasks
    monkeypatch.setattr(files, "TASK_BYTES", 10 * len(raw))
    assert files.load_header(spark, str(tmp_path)).rdd.getNumPartitions() == 200
    # the listing goes through few tasks too
    assert files.dealt(files.list_files(spark, str(tmp_path)), 0, 0)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
    done = files.convert_to_mgzip(spark, str(tmp_path), str(tmp_path / "out")).collect()
    assert len({r["target"] for r in done}) == 2000 and all(r["written"] for r in done)
    assert files.load(spark, str(tmp_path / "out")).where(F.col("data") == F.array(*[F.lit(float(k)) for k in range(8)])).count() == 2000


def test_rows_share_batches():
    import pyarrow as pa

    kinds = pa.schema([("k", pa.int64()), ("data", pa.list_(pa.float64()))])
    small, large = np.arange(3.0), np.zeros(files.BATCH_BYTES // 8)
    rows = [(k, large if k in (300, 301) else small) for k in range(600)]
    out = list(files.batched(iter(rows), kinds))
    assert [b.num_rows for b in out] == [256, 44, 1, 1, 256, 42]
    assert [(r["k"], r["data"]) for b in out for r in b.to_pylist()] == [(k, x.tolist()) for k, x in rows]
    assert list(files.batched(iter([]), kinds)) == []


def test_magic_of_members():
    raw = bytes(100)
    assert files.is_mgzip(gzip.compress(raw) * 2) and not files.is_mgzip(gzip.compress(raw)) and not files.is_mgzip(raw) and not files.is_mgzip(b"")
