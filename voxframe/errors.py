"""Exceptions of the engine and checks of arguments, made before a plan is built."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence


class VolumeError(Exception):
    """Any error of the engine; ``suggestions`` say what may help."""

    def __init__(self, message: str, suggestions: Sequence[str] = ()) -> None:
        super().__init__("\n".join([message, *(f"- {s}" for s in suggestions)]))
        self.suggestions = list(suggestions)


class LoadError(VolumeError, OSError):
    """A file that is missing or can't be read."""


class ValidationError(VolumeError, ValueError):
    """An argument out of its range."""


class DeviceError(VolumeError, ValueError):
    """A device that tensors can't be put on."""


class TransformError(VolumeError, ValueError):
    """A transform that doesn't fit its volume."""


class VolumeMemoryError(VolumeError, MemoryError):
    """A volume that doesn't fit."""


class ConfigurationError(VolumeError, ValueError):
    """Options that contradict each other."""


def check_shape(shape: Sequence[int], name: str = "shape", axes: int = 3) -> list[int]:
    """``axes`` positive whole numbers."""
    out = list(shape)
    if len(out) != axes or any(isinstance(d, bool) or not isinstance(d, int) or d < 1 for d in out):
        raise ValidationError(f"{name} must be {axes} positive whole numbers, not {shape!r}")
    return out


def check_spacing(spacing: Sequence[float], name: str = "spacing") -> list[float]:
    """Three finite numbers above 0."""
    out = [float(s) for s in spacing]
    if len(out) != 3 or any(not math.isfinite(s) or s <= 0 for s in out):
        raise ValidationError(f"{name} must be three finite numbers above 0, not {spacing!r}")
    return out


def check_range(low: float, high: float) -> tuple[float, float]:
    """Finite, and the first below the second."""
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValidationError(f"a range must be finite and ascending, not {low!r} to {high!r}")
    return float(low), float(high)


def check_probability(p: float) -> float:
    if not 0 <= p <= 1:
        raise ValidationError(f"a probability must be in 0 to 1, not {p!r}")
    return float(p)


def check_axes(axes: Sequence[int]) -> list[int]:
    """Distinct axes among 0, 1 and 2."""
    out = list(axes)
    if any(a not in (0, 1, 2) for a in out) or len(set(out)) != len(out):
        raise ValidationError(f"axes must be distinct and among 0, 1, 2, not {axes!r}")
    return out


def check_orientation(code: str) -> str:
    """Three letters, one of each of RL, AP and SI; upper case is returned."""
    up = code.upper()
    if len(up) != 3 or any(sum(c in pair for c in up) != 1 for pair in ("RL", "AP", "SI")):
        raise ValidationError(f"no orientation code: {code!r}", ["use three letters such as RAS or LPS"])
    return up


def check_device(device: str) -> str:
    """cpu, mps, cuda or cuda with a number."""
    kind, colon, number = device.partition(":")
    if kind not in ("cpu", "cuda", "mps") or colon and (kind != "cuda" or not number.isdigit()):
        raise DeviceError(f"unknown device {device!r}", ["use cpu, mps, cuda or cuda:0"])
    return device


def check_local_file(path: str | os.PathLike[str], suffixes: Sequence[str] = (".nii", ".nii.gz", ".nii.mgz")) -> str:
    """A volume file on this machine that is there."""
    text = os.fspath(path)
    if not text or "\0" in text:
        raise ValidationError("an empty path or one with a zero byte")
    if not text.lower().endswith(tuple(suffixes)):
        raise ValidationError(f"{text} has none of the suffixes {', '.join(suffixes)}")
    if not os.path.isfile(text):
        raise LoadError(f"no file {text}", ["check the path"])
    return text
