"""Means of polynomial kernels over all pairs of two sets, from moments of each set.

(<x, y> / d + 1)^p is a sum of powers of <x, y> up to p, and the mean of <x, y>^j over all pairs is the inner
product of the two sets' j-th moments (the mean of x in itself j times). So one pass a set replaces the loop over pairs, and
the mean kernel of a vector to a set is a polynomial of the vector. It is exact up to rounding. Moments are
symmetric: of degree 2 only i <= j is kept and of degree 3 i <= j <= k, some ``d^3 / 6`` numbers, whatever the rows.

For degrees 1 to ``DEGREE`` and up to ``WIDTH`` dimensions; :func:`fits` tells. A null vector is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.vectors import matrix

DEGREE, WIDTH = 3, 96
ROWS = 256  # of a tile, which makes some arrays of ``WIDTH^2 / 2`` numbers a row


def fits(width: int, degree: int) -> bool:
    return 1 <= degree <= DEGREE and 0 < width <= WIDTH


def width_of(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()["d"]


def _couples(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i <= j of all couples, and how often a couple stands in the full matrix."""
    i, j = np.triu_indices(d)
    return i, j, np.where(i == j, 1.0, 2.0)


@dataclass
class Moments:
    """Means over a set: of x, of x_i x_j (i <= j) and of x_i x_j x_k (all k), and the sum of each vector's kernel with itself."""

    n: int
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    own: float

    def with_all(self, other: Moments, degree: int) -> float:
        """The mean kernel over all pairs of both sets."""
        d, weight = len(self.one), _couples(len(self.one))[2]
        powers = [1.0, self.one @ other.one, (weight * self.two) @ other.two, float((weight[:, None] * self.three * other.three).sum()) if degree > 2 else 0.0]
        return float(sum(comb(degree, j) * powers[j] / d**j for j in range(degree + 1)))

    def with_each(self, x: np.ndarray, degree: int) -> np.ndarray:
        """The mean kernel of each row of ``x`` to the set."""
        d = len(self.one)
        i, j, weight = _couples(d)
        out = np.empty(len(x))
        for at in range(0, len(x), ROWS):
            y = x[at : at + ROWS]
            products = y[:, i] * y[:, j] * weight
            powers = [np.ones(len(y)), y @ self.one, products @ self.two, ((products @ self.three) * y).sum(1) if degree > 2 else np.zeros(len(y))]
            out[at : at + ROWS] = sum(comb(degree, p) * powers[p] / d**p for p in range(degree + 1))
        return out


def moments_of(df: DataFrame, width: int, degree: int = 3) -> Moments | None:
    """Of the vectors of (x); None of an empty set. Every task adds up its own sums."""
    d = width
    i, j, _ = _couples(d)
    triple = np.arange(d)[None, :] >= j[:, None]  # i <= j <= k
    size = 2 + d + len(i) + (int(triple.sum()) if degree > 2 else 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own, one, two, three = 0, 0.0, np.zeros(d), np.zeros(len(i)), np.zeros((len(i), d))
        for b in batches:
            whole = matrix(b.column(0))
            for at in range(0, len(whole), ROWS):
                x = whole[at : at + ROWS]
                products = x[:, i] * x[:, j]
                n, own, one, two = n + len(x), own + float(((np.square(x).sum(1) / d + 1.0) ** degree).sum()), one + x.sum(0), two + products.sum(0)
                if degree > 2:
                    three += products.T @ x
        flat = np.concatenate([[n, own], one, two, three[triple] if degree > 2 else []])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(flat)], ["i", "v"])

    rows = df.where("x is not null").select("x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(size)
    flat[np.asarray(rows["i"])] = np.asarray(rows["v"])
    n = int(flat[0])
    if not n:
        return None
    three = np.zeros((len(i), d))
    if degree > 2:
        full = np.zeros((d, d, d))
        a, c = np.nonzero(triple)
        values = flat[2 + d + len(i) :] / n
        for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
            index = (i[a], j[a], c)
            full[index[order[0]], index[order[1]], index[order[2]]] = values
        three = full[i, j]
    return Moments(n, flat[2 : 2 + d] / n, flat[2 + d : 2 + d + len(i)] / n, three, float(flat[1]))


def kernel_means(left: DataFrame, right: DataFrame, width: int, degree: int = 3) -> DataFrame:
    """(id, mean): the mean kernel of each left vector over the right set; an empty set gives no rows."""
    of = moments_of(right, width, degree)
    if of is None:
        return left.sparkSession.createDataFrame([], "id long, mean double")
    sent = left.sparkSession.sparkContext.broadcast(of)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(sent.value.with_each(matrix(b["x"]), degree))], ["id", "mean"])

    return left.select("id", "x").mapInArrow(mean, "id long, mean double")
