"""Small matrices as arrays of rows of doubles, one to a table row, and projective maps of the plane."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def identity(n: int) -> Column:
    return F.array(*(F.array(*(F.lit(float(i == j)) for j in range(n))) for i in range(n)))


def scale(m: Column, k: Column) -> Column:
    return F.transform(m, lambda row: F.transform(row, lambda x: x * k))


def times_vector(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def multiply(a: Column, b: Column) -> Column:
    columns = transpose(b)
    return F.transform(a, lambda row: F.transform(columns, lambda c: dot(row, c)))


def equal(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """Whether all elements agree within the tolerance and the shapes do."""
    flat = lambda m: F.flatten(m)
    same = F.forall(F.zip_with(flat(a), flat(b), lambda x, y: F.abs(x - y) <= tolerance), lambda fine: F.coalesce(fine, F.lit(False)))
    return same & (F.size(a) == F.size(b)) & (F.size(flat(a)) == F.size(flat(b)))


def projection(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float]:
    """Eight coefficients that carry four points to four others; the identity if there are none."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        return [round(c, 10) for c in np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist()]
    except np.linalg.LinAlgError:
        return [1, 0, 0, 0, 1, 0, 0, 0]


def project(coefficients: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """Where a point goes; the way back is ``projection`` with its arguments changed over."""
    c = [F.lit(float(v)) for v in coefficients]
    w = c[6] * x + c[7] * y + 1
    return (c[0] * x + c[1] * y + c[2]) / w, (c[3] * x + c[4] * y + c[5]) / w
