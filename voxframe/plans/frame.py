"""A method chain over volumes: ``load(spark, path).resample([1, 1, 1]).z_normalize().clamp(-2, 2).save(folder)``.

Nothing is read before ``save``, ``materialize`` or an action on ``df``; steps next to each other run in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from voxframe.errors import check_axes, check_orientation, check_range, check_shape, check_spacing
from voxframe.operators import intensity, volume
from voxframe.plans.pipeline import Step, TransformPipeline
from voxframe.sources import files


class VolumeFrame:
    """Volumes and the steps that wait for them; every method gives a new one."""

    def __init__(self, source: DataFrame, pending: TransformPipeline | None = None) -> None:
        self.source, self.pending = source, pending or TransformPipeline()

    @property
    def df(self) -> DataFrame:
        """The volumes with all steps applied."""
        return self.pending.apply(self.source)

    def push(self, step: Step) -> VolumeFrame:
        return VolumeFrame(self.source, TransformPipeline([*self.pending.steps, step]))

    def __len__(self) -> int:
        """Steps that wait."""
        return len(self.pending)

    def __repr__(self) -> str:
        return f"VolumeFrame({', '.join(self.source.columns)}; {len(self)} steps)"

    def resample(self, spacing: list[float], method: str = "trilinear") -> VolumeFrame:
        return self.push(volume.resample_to_spacing(check_spacing(spacing), volume.method_of(method)))

    def resample_to_shape(self, size: list[int], method: str = "trilinear") -> VolumeFrame:
        return self.push(volume.resample_to_shape(check_shape(size), volume.method_of(method)))

    def reorient(self, code: str) -> VolumeFrame:
        return self.push(volume.reorient(check_orientation(code)))

    def z_normalize(self) -> VolumeFrame:
        return self.push(volume.z_normalize())

    def rescale(self, low: float = 0.0, high: float = 1.0) -> VolumeFrame:
        return self.push(volume.rescale(*check_range(low, high)))

    def clamp(self, low: float, high: float) -> VolumeFrame:
        return self.push(volume.clamp(*check_range(low, high)))

    def crop_or_pad(self, size: list[int], fill: float = 0.0) -> VolumeFrame:
        return self.push(volume.crop_or_pad(check_shape(size), fill))

    def flip(self, axes: list[int]) -> VolumeFrame:
        return self.push(volume.flip(check_axes(axes)))

    def with_dtype(self, dtype: str) -> VolumeFrame:
        return self.push(lambda df: intensity.with_dtype(df, dtype))

    def materialize(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> VolumeFrame:
        """The same with its steps done, kept by the executors once they are first read."""
        return VolumeFrame(self.df.persist(level))

    def is_materialized(self) -> bool:
        return not len(self) and self.source.storageLevel != StorageLevel.NONE

    def save(self, folder: str, name: str | None = None, compression: str = "none", dtype: str = "float32", overwrite: bool = True) -> int:
        """Write all volumes and return their number; without ``name`` files keep the names that they were read from."""
        df = self.df
        if name is None:
            df, name = df.withColumn("_file", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?i)\.nii(\.gz|\.mgz)?$", "")), "_file"
        return files.save(df, folder, name, compression, dtype, overwrite).count()


def load(spark: SparkSession, path: str | list[str]) -> VolumeFrame:
    return VolumeFrame(files.load(spark, path))
