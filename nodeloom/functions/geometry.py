"""Three-dimensional geometry on separate coordinate columns, which keeps it inside generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot3(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm3(a: Vector) -> Column:
    return F.sqrt(dot3(a, a))


def angle3(a: Vector, b: Vector) -> Column:
    """Radians between two vectors, clipped; null if either is zero."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot3(a, b) / F.nullif(norm3(a) * norm3(b), F.lit(0.0)))))


def dihedral3(a: Vector, b: Vector, c: Vector) -> Column:
    """Radians from -pi to pi around b, for the chain of bond vectors a, b, c; null where three atoms are in line."""
    n1, n2 = cross3(a, b), cross3(b, c)
    return F.when((dot3(n1, n1) > 0) & (dot3(n2, n2) > 0), F.atan2(dot3(a, n2) * norm3(b), dot3(n1, n2)))


def minimum_image(d: Column, length: Column) -> Column:
    """A difference of coordinates in a periodic box, brought back once if it is beyond half the box."""
    return F.when(d > length / 2, d - length).when(d < -length / 2, d + length).otherwise(d)


def minimum_image_cell(d: Vector, cell: list[list[float]]) -> Vector:
    """The same for a cell with rows as lattice vectors: fractional coordinates are rounded off."""
    inverse = np.linalg.pinv(np.array(cell, float))
    f = [sum((d[i] * F.lit(float(inverse[i, j])) for i in range(3)), F.lit(0.0)) for j in range(3)]
    f = [x - F.round(x) for x in f]
    return tuple(sum((f[j] * F.lit(float(cell[j][i])) for j in range(3)), F.lit(0.0)) for i in range(3))


def wrap_cell(c: Column, n: Column) -> Column:
    """The cell of the box that a cell number outside of it stands for."""
    return F.pmod(c, n)


def cell_shift(c: Column, n: Column) -> Column:
    """How many boxes away a cell number lies."""
    return F.floor(c / n)


def unravel(index: Column, shape: tuple[Column, ...]) -> list[Column]:
    """Row-major coordinates of a flat index."""
    out = []
    for n in reversed(shape):
        out.append(F.pmod(index, n))
        index = F.floor(index / n)
    return out[::-1]
