"""Column expressions over array<double> vectors, and the same vectors as arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(1e-12)))


def poly_kernel(a: Column, b: Column, degree: int = 3) -> Column:
    """(<a, b> / d + 1) ** degree."""
    return F.pow(dot(a, b) / F.size(a) + 1.0, F.lit(float(degree)))


def rbf_kernel(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-sq_distance(a, b) / (2.0 * sigma * sigma))


def kernel(a: Column, b: Column, name: str = "poly", degree: int = 3, sigma: float | None = None) -> Column:
    """The kernel by name: ``poly`` (degree) or ``rbf`` (sigma)."""
    if name == "poly":
        return poly_kernel(a, b, degree)
    if name == "rbf":
        if not sigma or sigma <= 0:
            raise ValueError("an rbf kernel needs sigma > 0")
        return rbf_kernel(a, b, sigma)
    raise ValueError(f"unknown kernel: {name}")
