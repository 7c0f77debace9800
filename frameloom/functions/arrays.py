"""Functions on fixed-width arrays, poses and maps as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_width(c: Column, k: int) -> Column:
    """The array, or an error where its width isn't ``k``; null stays null."""
    return F.when(c.isNull() | (F.size(c) == k), c).otherwise(F.raise_error(F.concat(F.lit(f"expected {k} values, got "), F.size(c).cast("string"))))


def padded(c: Column, n: int) -> Column:
    """Cut or filled with zeros to n values."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(0).cast("double"), n)), 1, n)


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def at(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i)).cast("double")


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major 3x3 rotation of a unit quaternion x, y, z, w."""
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def geodesic_degrees(a: Column, b: Column, entries: list[int]) -> Column:
    """Angle between two rotations given as entries of row-major arrays, clipped against rounding."""
    trace = reduce(lambda s, i: s + at(a, i) * at(b, i), entries[1:], at(a, entries[0]) * at(b, entries[0]))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def camera_centre(m: Column) -> list[Column]:
    """-R'T of a row-major world-to-camera 4x4 pose."""
    return [-(at(m, i) * at(m, 3) + at(m, 4 + i) * at(m, 7) + at(m, 8 + i) * at(m, 11)) for i in range(3)]


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, near: float = 0.01) -> Column:
    """Struct ``u, v, visible`` of a point in front of the camera; null coordinates behind it."""
    ok = z > near
    return F.struct(F.when(ok, fx * x / z + cx).alias("u"), F.when(ok, fy * y / z + cy).alias("v"), ok.alias("visible"))


def mirrored(c: Column) -> Column:
    """Axis-angle triples of the other hand: the second and third of each three change their sign."""
    return F.transform(c, lambda v, i: F.when(i % 3 == 0, v).otherwise(-v))


def six_to_rows(c: Column) -> list[Column]:
    """Row-major rotation from its first two rows by Gram-Schmidt."""
    a, b = [at(c, i) for i in range(3)], [at(c, i + 3) for i in range(3)]
    na = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    x = [v / na for v in a]
    d = x[0] * b[0] + x[1] * b[1] + x[2] * b[2]
    y = [b[i] - d * x[i] for i in range(3)]
    ny = F.sqrt(y[0] * y[0] + y[1] * y[1] + y[2] * y[2])
    y = [v / ny for v in y]
    return [*x, *y, x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
