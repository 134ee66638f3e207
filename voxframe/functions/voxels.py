"""Column helpers for dense volumes: a row holds ``shape`` (array of int) and ``data`` (axis 0 fastest)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once a row even inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def num(x: int | Column) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def div(a: Column, b: int | Column) -> Column:
    """Integer division of non-negative integers."""
    return F.floor(a / num(b)).cast("int")


def count_of(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1), lambda n, d: n * d)


def uniform(*keys: object) -> Column:
    """A number in [0, 1) that is a function of its keys alone, so results don't depend on partitioning."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
