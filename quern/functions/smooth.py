"""A thin-plate regression spline of one variable, fitted from sums that the cluster forms.

The radial kernel |r|^3 / 12 between the distinct values (all of them up to KNOTS, else as many drawn by a hash) is cut to its
k largest eigenvalues; with the constraint that takes lines out of the radial part, and a line beside it, that is a basis of
k functions. The fit needs the k x k sums of their products only: the smoothing parameter is chosen on these by generalised
cross-validation, and each row gets its fitted value where it lies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KNOTS = 2000


class ThinPlate:
    """The basis on given knots, which are mapped to [0, 1]."""

    def __init__(self, knots: np.ndarray, k: int) -> None:
        x = np.unique(np.asarray(knots, float))
        self.low, self.width = x[0], (x[-1] - x[0]) or 1.0
        self.knots = (x - self.low) / self.width
        k = min(k, len(x))
        value, vector = np.linalg.eigh(np.abs(self.knots[:, None] - self.knots) ** 3 / 12)
        most = np.argsort(-np.abs(value), kind="stable")[:k]
        u, d = vector[:, most], value[most]
        line = np.c_[np.ones(len(x)), self.knots]
        free = np.linalg.qr(u.T @ line, mode="complete")[0][:, 2:]  # orthogonal to lines
        self.radial = u @ free
        self.penalty = np.zeros((k, k))
        self.penalty[: k - 2, : k - 2] = free.T @ (d[:, None] * free)

    def basis(self, x: np.ndarray) -> np.ndarray:
        u = (np.asarray(x, float) - self.low) / self.width
        return np.c_[np.abs(u[:, None] - self.knots) ** 3 / 12 @ self.radial, np.ones(len(u)), u]

    def solved(self, gram: np.ndarray, rhs: np.ndarray, squares: float, n: int, strength: float | None = None) -> np.ndarray:
        """Coefficients; without a strength of the penalty, that of the least n * RSS / (n - edf)^2."""
        scale = np.trace(gram) / max(np.trace(self.penalty), 1e-300)

        def fit(log10: float):
            a = np.linalg.lstsq(gram + 10.0**log10 * scale * self.penalty, np.c_[rhs, gram], rcond=1e-15)[0]
            b = a[:, 0]
            rss = max(squares - 2 * b @ rhs + b @ gram @ b, 0.0)
            return n * rss / max(n - np.trace(a[:, 1:]), 1e-9) ** 2, b

        if strength is not None:
            return fit(math.log10(strength / scale))[1]
        grid = np.arange(-12.0, 8.1, 0.5)
        at = int(np.argmin([fit(g)[0] for g in grid]))
        low, high, step = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)], (math.sqrt(5) - 1) / 2
        for _ in range(40):  # golden section
            a, b = high - step * (high - low), low + step * (high - low)
            low, high = (low, b) if fit(a)[0] <= fit(b)[0] else (a, high)
        best = round((low + high) / 2, 2)  # the criterion is flat there: so sums in another order give the same
        return fit(best if fit(best)[0] <= fit(grid[at])[0] else grid[at])[1]


def batch(b: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(b.column(column).to_numpy(zero_copy_only=False), float)


def fitted(points: DataFrame, x: str, y: str, k: int = 10) -> tuple[ThinPlate, np.ndarray]:
    """The smooth of y on x, both finite: its basis and coefficients. The driver gets the knots and k * (k + 1) + 2 sums."""
    values = points.select(F.col(x).alias("x")).distinct()
    knots = [r.x for r in values.orderBy(F.xxhash64(F.lit(5), "x"), "x").limit(KNOTS).collect()]
    ends = points.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    plate = ThinPlate(np.array([*knots, ends.low, ends.high]), k)
    size = plate.penalty.shape[0]

    def sums(batches):
        total = np.zeros(size * size + size + 2)
        for b in batches:
            basis, v = plate.basis(batch(b, x)), batch(b, y)
            total += np.r_[(basis.T @ basis).ravel(), basis.T @ v, v @ v, len(v)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    total = np.zeros(size * size + size + 2)
    for r in points.select(x, y).mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r.i] = r.s
    gram, rhs = total[: size * size].reshape(size, size), total[size * size : -2]
    return plate, plate.solved((gram + gram.T) / 2, rhs, total[-2], int(total[-1]))
