"""Loaders, subject-wise adapters, the data source, the command line and the checks."""

import numpy as np
import pytest

from voxframe import cli, errors
from voxframe.operators import adapters, augment, grid, loaders, sampling, subjects, volume
from voxframe.plans.pipeline import TransformPipeline
from voxframe.sources import datasource, files, nifti

SCHEMA = "vec_id long, shape array<int>, spacing array<double>, affine array<double>, data array<double>"
RAS = [1.0, 0.0, 0.0, 10.0, 0.0, 1.0, 0.0, 20.0, 0.0, 0.0, 2.5, 30.0]


def ramp(nx, ny, nz):
    return [float(x + 10 * y + 100 * z) for z in range(nz) for y in range(ny) for x in range(nx)]


@pytest.fixture(scope="module")
def volumes(spark):
    rows = [(k, [5 + k, 4, 6], [1.0, 1.0, 2.5], RAS, ramp(5 + k, 4, 6)) for k in range(4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_training_loader_gives_exactly_n_of_each_and_another_order_next_time(volumes):
    loader = loaders.training_loader(volumes, loaders.PatchConfig((2, 2, 3), 9), seed=1, batch_size=5)
    first = [(row["vec_id"], row["k"], grid_.tolist()) for batch in loader for row, grid_ in batch]
    assert len(first) == 36 and {k: sum(v == k for v, _, _ in first) for k in range(4)} == dict.fromkeys(range(4), 9)
    assert (loader.stats.patches, loader.stats.batches, len(loader.stats.volumes), len(loader)) == (36, 8, 4, 8)
    again = [(row["vec_id"], row["k"], grid_.tolist()) for batch in loader for row, grid_ in batch]
    assert again == first
    second = [(row["vec_id"], row["k"]) for batch in loader.reset() for row, _ in batch]
    assert sorted(second) == sorted((v, k) for v, k, _ in first) and second != [(v, k) for v, k, _ in first]
    assert (loader.stats.epoch, loader.stats.patches) == (1, 36)


def test_patches_are_boxes_of_their_volume(volumes):
    for row in sampling.patches(volumes, [2, 3, 4], 7, lattice=False).collect():
        box = np.array(ramp(5 + row["vec_id"], 4, 6)).reshape([5 + row["vec_id"], 4, 6], order="F")[row["x0"] : row["x0"] + 2, row["y0"] : row["y0"] + 3, row["z0"] : row["z0"] + 4]
        assert row["data"] == box.ravel(order="F").tolist() and row["affine"][3] == 10 + row["x0"] and row["affine"][11] == 30 + 2.5 * row["z0"]
    big = sampling.patches(volumes, [64, 64, 64], 2).collect()
    assert len(big) == 8 and all(r["shape"] == [5 + r["vec_id"], 4, 6] for r in big)


def test_fast_and_crop_loaders(volumes):
    got = [g.shape for batch in loaders.fast_loader(volumes, (2, 2, 2), batch_size=3, transform=lambda g: g + 1) for _, g in batch]
    assert got == [(2, 2, 2)] * 4
    lattice = [row["vec_id"] for batch in loaders.crop_loader(volumes, loaders.PatchConfig((2, 2, 2), None)) for row, _ in batch]
    assert len(lattice) == sum((5 + k) // 2 * 2 * 3 for k in range(4))
    with pytest.raises(ValueError):
        loaders.PatchConfig((2, 2, 2), overlap=2)


def subject_rows(spark):
    label = [float(v > 300) for v in ramp(6, 4, 6)]
    rows = [(s, key, key == 1, [6, 4, 6], [1.0, 1.0, 2.5], RAS, label if key else ramp(6, 4, 6)) for s in range(3) for key in (0, 1)]
    return spark.createDataFrame(rows, "subject long, key int, is_label boolean, shape array<int>, spacing array<double>, affine array<double>, data array<double>")


def test_label_aware_crops_of_all_files(spark):
    rows = adapters.label_aware_crops(subject_rows(spark), [2, 2, 2], 4, ratio=1.0).collect()
    assert len(rows) == 24
    image = {(r["subject"], r["k"]): r for r in rows if r["key"] == 0}
    for r in rows:
        if r["key"] == 1:
            assert r["affine"] == image[r["subject"], r["k"]]["affine"]
            assert r["data"] == [float(v > 300) for v in image[r["subject"], r["k"]]["data"]]
            assert r["positive"] == (r["k"] < 2) and (not r["positive"] or any(r["data"]))
    assert sampling.positives_of(1, 1.0, 0) == 1 and sampling.positives_of(4, 3.0, 1) == 3 and sampling.positives_of(4, 0.0, 2) == 2


def test_subject_transforms(spark):
    df = subject_rows(spark)
    turned = adapters.orientation(df, "lps", keys=[0]).collect()
    assert {(r["key"], r["affine"][0]) for r in turned} == {(0, -1.0), (1, 1.0)}
    boxes = adapters.center_crop(df, [2, 2, 2]).collect()
    assert all(r["shape"] == [2, 2, 2] and r["affine"][3::4] == [12.0, 21.0, 35.0] for r in boxes)
    assert {tuple(r["affine"]) for r in adapters.random_crop(df, [2, 2, 2]).where("subject = 0").collect()}.__len__() == 1
    near = subjects.coordinated_crop(df, [2, 2, 2], 3, margin=1).collect()
    assert all(abs(r["affine"][3] - 12) <= 1 for r in near)
    sized = adapters.resample(df, size=[3, 2, 3]).collect()
    assert all(set(r["data"]) <= {0.0, 1.0} for r in sized if r["is_label"]) and all(r["spacing"] == [2.0, 2.0, 5.0] for r in sized)
    spaced = subjects.normalize(df, [2.0, 2.0, 2.5], orientation="LAS").collect()
    assert all(r["shape"] == [3, 2, 6] and r["affine"][0] == -2.0 for r in spaced)
    assert adapters.with_metadata(df).first()["meta"]["spacing"] == [1.0, 1.0, 2.5]
    assert adapters.file_name("/a/b.nii.gz") == "b_trans.nii.gz" and adapters.file_name("x.nii", "", ".nii") == "x.nii"
    assert spark.range(1).select(adapters.file_name(adapters.F.lit("/a/b.NII.gz"), "seg")).first()[0] == "b_seg.nii.gz"


def test_data_source(spark, volumes, tmp_path):
    datasource.register(spark)
    volumes.write.format("nifti").mode("append").option("compression", "gzip").option("dtype", "float64").save(str(tmp_path))
    head = spark.read.format("nifti").option("what", "header").load(str(tmp_path)).collect()
    assert len(head) == 4 and all(r["gzipped"] and r["dtype"] == "float64" for r in head)
    box = spark.read.format("nifti").option("start", "1,0,2").option("stop", "3,2,3").load(str(tmp_path)).collect()
    assert {tuple(r["data"]) for r in box} == {(201.0, 202.0, 211.0, 212.0)} and box[0]["affine"][3] == 11.0
    whole = {r["path"].rsplit("/", 1)[1]: r["data"] for r in spark.read.format("nifti").load(str(tmp_path)).collect()}
    assert whole == {f"{k}.nii.gz": ramp(5 + k, 4, 6) for k in range(4)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.nii").write_bytes(nifti.encode(np.array(ramp(3, 2, 2)), [3, 2, 2]))
    assert cli.main(["convert-mgzip", str(tmp_path), "-o", str(tmp_path / "out")], spark) == 0
    assert files.load(spark, str(tmp_path / "out")).first()["data"] == ramp(3, 2, 2)
    assert cli.main(["info", str(tmp_path / "*.nii")], spark) == 0
    assert cli.main(["convert-mgzip", str(tmp_path / "none*")], spark) == 1
    assert "3x2x2 float32 RAS" in capsys.readouterr().out


@pytest.mark.parametrize("call", [lambda: errors.check_shape([]), lambda: errors.check_shape([1, 0, 2]), lambda: errors.check_shape([64.5, 1, 1]), lambda: errors.check_spacing([1, 1, -1]), lambda: errors.check_range(1, 1), lambda: errors.check_probability(1.5), lambda: errors.check_axes([0, 3]), lambda: errors.check_orientation("RAX"), lambda: errors.check_orientation("RRS"), lambda: errors.check_device("tpu"), lambda: errors.check_local_file("a.txt"), lambda: volume.method_of("cubic")])
def test_bad_arguments_are_refused(call):
    with pytest.raises(ValueError):
        call()


def test_good_arguments():
    assert errors.check_shape([1, 2, 3]) == [1, 2, 3] and errors.check_orientation("lps") == "LPS" and errors.check_device("cuda:1") == "cuda:1"
    with pytest.raises(OSError):
        errors.check_local_file("/nowhere/a.nii")
    assert str(errors.LoadError("no", ["try"])) == "no\n- try"


def test_kernels_on_nulls_floats_and_empty_volumes(spark):
    rows = [(1, [2, 1, 1], [1.0, None]), (2, [0, 0, 0], []), (3, None, None), (4, [2, 1, 1], [3.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, shape array<int>, data array<float>")
    out = {r["vec_id"]: r["data"] for r in TransformPipeline().linear(2.0, 1.0).linear(3.0, 0.0).clamp(0.0, 30.0).apply(df).collect()}
    assert out == {1: [9.0, None], 2: [], 3: None, 4: [21.0, 30.0]}
    assert {r["vec_id"]: r["data"] for r in TransformPipeline().z_normalize().rescale(0.0, 1.0).flip([0]).apply(df).collect()}[4] == [1.0, 0.0]
    assert grid.crop_or_pad(df.where("vec_id = 4"), [4, 1, 1]).first()["data"] == [0.0, 3.0, 5.0, 0.0]


def test_pipelines_fuse(spark, volumes):
    steps = TransformPipeline().linear(2.0, 1.0).linear(0.5, -1.0).flip([1])
    assert [k.name for k in volume.fused(steps.steps)] == ["linear", "flip"] and len(steps) == 3 and TransformPipeline().is_empty()
    plan = lambda p: p.apply(volumes)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert plan(steps) == 1
    want = {r["vec_id"]: r["data"] for r in steps.apply(volumes).collect()}
    assert plan(steps.set_lazy(False)) == 3 and {r["vec_id"]: r["data"] for r in steps.apply(volumes).collect()} == want


def test_augmentation_options(volumes):
    plain = augment.RandomAugment(3).without("flip_axes", "scale", "shift", "noise")
    assert {r["vec_id"]: r["data"] for r in plain.apply(volumes).collect()} == {k: ramp(5 + k, 4, 6) for k in range(4)}
    assert augment.RandomAugment(3, gamma=(1.0, 1.0)).apply(volumes).count() == 4


def test_resampling_keeps_the_extent(volumes):
    row = grid.resample_to_spacing(volumes, [2.0, 0.5, 2.5]).where("vec_id = 1").first()
    assert (row["shape"], row["spacing"]) == ([3, 8, 6], [2.0, 0.5, 2.5]) and row["affine"][0] == 2.0 and row["affine"][5] == 0.5
