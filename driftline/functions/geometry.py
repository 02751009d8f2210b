"""Vectors of three columns, periodic boxes, angles and bins, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def nearest_integer(q: Column) -> Column:
    """Halves away from zero; unlike round() without a detour through decimals."""
    return F.signum(q) * F.floor(F.abs(q) + 0.5)


def min_image(d: Vec, box: Vec | Column | None) -> Vec:
    """The shortest image of a difference; lengths of zero or less are not periodic.

    A box of three lengths, or a column of a cell's nine numbers (its vectors in
    rows), which rounds each cell coordinate; null: not periodic.
    """
    if box is None:
        return d
    if isinstance(box, Column):
        f = [x - nearest_integer(x) for x in cell_coordinates(d, box)]
        return tuple(F.when(box.isNull(), x).otherwise(y) for x, y in zip(d, from_cell(f, box), strict=True))
    return tuple(F.when(b > 0, x - nearest_integer(x / b) * b).otherwise(x) for x, b in zip(d, box, strict=True))


def cell_vectors(cell: Column) -> list[Vec]:
    return [tuple(cell[3 * i + k] for k in range(3)) for i in range(3)]


def cell_volume(cell: Column) -> Column:
    a, b, c = cell_vectors(cell)
    return dot(a, cross(b, c))


def cell_coordinates(d: Vec, cell: Column) -> list[Column]:
    """The multiples of the cell's vectors that make ``d``."""
    a, b, c = cell_vectors(cell)
    return [dot(d, cross(p, q)) / cell_volume(cell) for p, q in ((b, c), (c, a), (a, b))]


def from_cell(f: list[Column], cell: Column) -> Vec:
    return tuple(sum(x * v[k] for x, v in zip(f, cell_vectors(cell), strict=True)) for k in range(3))


def wrap(x: Column, length: Column) -> Column:
    return x - F.floor(x / length) * length


def clamp(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def angle(u: Vec, v: Vec, degrees: bool = True) -> Column:
    """0 where a vector has no length."""
    n = norm(u) * norm(v)
    a = F.acos(clamp(dot(u, v) / n))
    return F.when(n > 0, F.degrees(a) if degrees else a).otherwise(F.lit(0.0))


def dihedral(p: list[Vec], box: Vec | None = None, degrees: bool = True, range360: bool = False) -> Column:
    b1, b2, b3 = (min_image(sub(q, o), box) for o, q in zip(p, p[1:], strict=False))
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return signed(F.atan2(norm(b2) * dot(b1, n2), dot(n1, n2)), degrees, range360)


def signed(a: Column, degrees: bool, range360: bool) -> Column:
    full = 360.0 if degrees else 2 * math.pi
    a = F.degrees(a) if degrees else a
    return F.when(a < 0, a + full).otherwise(a) if range360 else a


def wrapped_difference(a: Column, b: Column, full: float = 360.0) -> Column:
    d = a - b
    return d - full * nearest_integer(d / full)


def periodic_bin(x: Column, length: Column, bins: int | Column) -> Column:
    n = bins if isinstance(bins, Column) else F.lit(bins)
    return F.least(F.floor(wrap(x, length) / length * n), n - 1)


def bounded_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Null outside; the upper edge belongs to the last bin."""
    inside = (x >= low) & (x <= high)
    return F.when(inside, F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)))


def rotate_about(p: Vec, origin: Vec, axis: Vec, theta: Column) -> Vec:
    """Rodrigues rotation of a point about an axis through ``origin``."""
    n = norm(axis)
    k = tuple(c / n for c in axis)
    v = sub(p, origin)
    kv, kd = cross(k, v), dot(k, v)
    return tuple(o + a * F.cos(theta) + b * F.sin(theta) + c * kd * (1 - F.cos(theta)) for o, a, b, c in zip(origin, v, kv, k, strict=True))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Vec:
    """Of a symmetric 3 x 3 matrix, ascending, in closed form."""
    q = (xx + yy + zz) / 3.0
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6.0)
    a, b, c, d, e, f = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0
    phi = F.acos(clamp(half)) / 3.0
    top = F.when(p > 0, q + 2.0 * p * F.cos(phi)).otherwise(q)
    low = F.when(p > 0, q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)).otherwise(q)
    return (low, 3.0 * q - top - low, top)
