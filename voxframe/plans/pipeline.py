"""A pipeline of volume transforms: an ordered list of kernels and DataFrame functions, applied lazily as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voxframe.operators import volume
from voxframe.operators.volume import Kernel, each_volume

Step = Kernel | Callable[[DataFrame], DataFrame]


class TransformPipeline:
    """Builder; each method adds a step and returns the pipeline.

    Kernels next to each other run in one pass over the volumes, linear maps among them as one. With ``lazy``
    off each step is a plan node of its own.
    """

    def __init__(self, steps: list[Step] | None = None, lazy: bool = True) -> None:
        self.steps: list[Step] = list(steps or [])
        self.lazy = lazy

    def push(self, step: Step) -> TransformPipeline:
        self.steps.append(step)
        return self

    def set_lazy(self, lazy: bool) -> TransformPipeline:
        self.lazy = lazy
        return self

    def z_normalize(self) -> TransformPipeline:
        return self.push(volume.z_normalize())

    def rescale(self, low: float = 0.0, high: float = 1.0) -> TransformPipeline:
        return self.push(volume.rescale(low, high))

    def clamp(self, low: float, high: float) -> TransformPipeline:
        return self.push(volume.clamp(low, high))

    def linear(self, slope: float, offset: float) -> TransformPipeline:
        return self.push(volume.linear(slope, offset))

    def flip(self, axes: list[int]) -> TransformPipeline:
        return self.push(volume.flip(axes))

    def reorient(self, target: str) -> TransformPipeline:
        return self.push(volume.reorient(target))

    def crop_or_pad(self, size: list[int], fill: float = 0.0) -> TransformPipeline:
        return self.push(volume.crop_or_pad(size, fill))

    def resample_to_shape(self, size: list[int], method: str = "trilinear") -> TransformPipeline:
        return self.push(volume.resample_to_shape(size, method))

    def resample_to_spacing(self, target: list[float], method: str = "trilinear") -> TransformPipeline:
        """From each volume's own spacing."""
        return self.push(volume.resample_to_spacing(target, method))

    def __len__(self) -> int:
        return len(self.steps)

    def is_empty(self) -> bool:
        return not self.steps

    def apply(self, df: DataFrame) -> DataFrame:
        held: list[Kernel] = []
        for step in [*self.steps, None]:
            if isinstance(step, Kernel):
                held.append(step)
            if held and (not self.lazy or not isinstance(step, Kernel)):
                df, held = each_volume(df, *held), []
            if step is not None and not isinstance(step, Kernel):
                df = df.transform(step)
        return df
