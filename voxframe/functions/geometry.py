"""Affine geometry as column expressions; an affine is an array of rows (array<array<double>>)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxframe.functions.voxels import let

#: Letters of the positive and the negative direction of each world axis.
LETTERS = (("R", "L"), ("A", "P"), ("S", "I"))
FLAT = 1e-10


def cell(affine: Column, row: int, column: int) -> Column:
    return F.get(F.get(affine, row), column)


def matrix_of(rows: list[list[Column]]) -> Column:
    return F.array(*[F.array(*[c.cast("double") for c in row]) for row in rows])


def orientation_code(affine: Column) -> Column:
    """Three letters: for each voxel axis the world axis that it runs along.

    The largest component decides, the later of equal ones; its sign picks the letter. A column
    without length keeps the axis' own letter.
    """
    def letter(a: Column, k: int) -> Column:
        size = [F.abs(cell(a, r, k)) for r in range(3)]
        signed = [F.when(cell(a, r, k) < 0, LETTERS[r][1]).otherwise(LETTERS[r][0]) for r in range(3)]
        pick = F.when((size[0] > size[1]) & (size[0] > size[2]), signed[0]).when(size[1] > size[2], signed[1]).otherwise(signed[2])
        return F.when(F.greatest(*size) < FLAT, LETTERS[k][0]).otherwise(pick)

    return let(affine, lambda a: F.concat(*[letter(a, k) for k in range(3)]))


def transform_point(affine: Column, point: list[Column]) -> list[Column]:
    return [cell(affine, r, 0) * point[0] + cell(affine, r, 1) * point[1] + cell(affine, r, 2) * point[2] + cell(affine, r, 3) for r in range(3)]


def inverse(affine: Column) -> Column:
    """The inverse of a 3 x 4 affine by cofactors; null where the determinant is below 1e-10."""
    def inverted(a: Column) -> Column:
        m = [[cell(a, r, c) for c in range(4)] for r in range(3)]
        minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
        det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
        rows = [[minor(c, r) / det for c in range(3)] for r in range(3)]
        shift = [-(row[0] * m[0][3] + row[1] * m[1][3] + row[2] * m[2][3]) for row in rows]
        return F.when(F.abs(det) >= FLAT, matrix_of([[*row, s] for row, s in zip(rows, shift, strict=True)]))

    return let(affine, inverted)


def from_quaternion(b: Column, c: Column, d: Column, offset: list[Column], spacing: list[Column], handed: Column) -> Column:
    """The affine of a unit quaternion's last three parts; a negative ``handed`` reverses the third axis."""
    def affine(q: Column) -> Column:
        a, b, c, d = (q[n] for n in "abcd")
        turn = [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
        scale = [spacing[0], spacing[1], spacing[2] * F.when(handed < 0, -1.0).otherwise(1.0)]
        return matrix_of([[*[t * s for t, s in zip(row, scale, strict=True)], o] for row, o in zip(turn, offset, strict=True)])

    a = F.sqrt(F.greatest(F.lit(0.0), 1 - b * b - c * c - d * d))
    return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), affine)


def rows_of(matrix: list[list[float]]) -> Column:
    """A constant 3 x 4 affine."""
    return matrix_of([[F.lit(float(x)) for x in row] for row in matrix])


def identity() -> Column:
    return scale([1.0, 1.0, 1.0])


def scale(factors: list[float | Column]) -> Column:
    return matrix_of([[_number(f) if c == r else F.lit(0.0) for c in range(4)] for r, f in enumerate(factors)])


def translate(offset: list[float | Column]) -> Column:
    return matrix_of([[*[F.lit(float(c == r)) for c in range(3)], _number(o)] for r, o in enumerate(offset)])


def flip_axes(axes: list[int], dims: list[int | Column]) -> Column:
    """Voxel index i of a listed axis becomes dim - 1 - i."""
    return matrix_of([[*[F.lit(float(c == r) * (-1.0 if r in axes else 1.0)) for c in range(3)], (_number(dims[r]) - 1 if r in axes else F.lit(0.0))] for r in range(3)])


def then(first: Column, second: Column) -> Column:
    """The affine that applies ``first`` and then ``second``."""
    def product(m: Column) -> Column:
        a, b = m["a"], m["b"]
        return matrix_of([[sum((cell(b, r, k) * cell(a, k, c) for k in range(3)), cell(b, r, 3) if c == 3 else F.lit(0.0)) for c in range(4)] for r in range(3)])

    return let(F.struct(first.alias("a"), second.alias("b")), product)


def spacing_of(affine: Column) -> Column:
    """The lengths of the affine's columns: what setting an affine makes of the spacing."""
    return let(affine, lambda a: F.array(*[F.sqrt(sum((cell(a, r, c) * cell(a, r, c) for r in range(3)), F.lit(0.0))) for c in range(3)]))


def of_code(code: Column, spacing: Column) -> Column:
    """The affine of a three-letter orientation code and a spacing, with the origin at 0; null for a code that isn't one."""
    letters = [F.substring(F.upper(code), k + 1, 1) for k in range(3)]
    along = lambda k, r: F.when(letters[k] == LETTERS[r][0], F.get(spacing, k)).when(letters[k] == LETTERS[r][1], -F.get(spacing, k)).otherwise(0.0)
    return F.when(is_code(code), matrix_of([[*[along(k, r) for k in range(3)], F.lit(0.0)] for r in range(3)]))


def is_code(code: Column) -> Column:
    """Three letters, one of each world axis, in either case."""
    up = F.upper(code)
    return (F.length(up) == 3) & up.rlike("[RL]") & up.rlike("[AP]") & up.rlike("[SI]")


def needs_version_2(shape: Column) -> Column:
    """An axis is beyond what version 1 of the format can say."""
    return F.exists(shape, lambda d: d > 32767)


def _number(x: float | Column) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))
