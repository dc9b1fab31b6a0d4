"""Means, squares and cross products of many columns in one scan.

Every task turns its Arrow batches into matrices and keeps one set of partial moments, merged in two levels by the rule
for co-moments about different means, so no large sums cancel. Missing cells are masked: each pair of columns has its own
complete rows. What reaches the driver is one set: columns squared, or one entry per wanted pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MERGED_PARTS = 16
"""Tasks that merge the partial sets before the last one does."""
PAIR_CELLS = 1 << 21
"""Cells of a block of rows times pairs."""


@dataclass
class Moments:
    """Per pair (a, b), over the rows where both have a value: number, both means, both sums of squared deviations and the
    sum of products of deviations. All arrays have one shape."""

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    square_a: np.ndarray
    square_b: np.ndarray
    cross: np.ndarray

    @classmethod
    def empty(cls, *shape: int) -> Moments:
        return cls(*(np.zeros(shape) for _ in range(6)))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        step_a, step_b, weight = other.mean_a - self.mean_a, other.mean_b - self.mean_b, self.n * share
        return Moments(
            n, self.mean_a + step_a * share, self.mean_b + step_b * share, self.square_a + other.square_a + step_a * step_a * weight,
            self.square_b + other.square_b + step_b * step_b * weight, self.cross + other.cross + step_a * step_b * weight,
        )

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean_a, self.mean_b, self.square_a, self.square_b, self.cross]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, *shape: int) -> Moments:
        return cls(*np.frombuffer(raw).reshape(6, *shape))

    def correlation(self, least_rows: int) -> np.ndarray:
        """r of each pair; NaN below ``least_rows`` rows and where a side is constant."""
        spread = np.sqrt(self.square_a) * np.sqrt(self.square_b)
        r = np.divide(self.cross, spread, out=np.full(self.n.shape, np.nan), where=(spread > 0) & (self.n >= least_rows))
        return np.clip(r, -1.0, 1.0)


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells less a centre of their column, 0 where missing; 1 where present; the centres). The centre is taken from the
    first value on, so a constant column has deviations of exactly 0."""
    present = ~np.isnan(x)
    first = np.nan_to_num(x[np.argmax(present, axis=0), np.arange(x.shape[1])])
    z = np.where(present, x - first, 0.0)
    middle = z.sum(axis=0) / np.maximum(present.sum(axis=0), 1)
    return np.where(present, z - middle, 0.0), present.astype(float), first + middle


def _set(n: np.ndarray, sums: tuple[np.ndarray, ...], centre_a: np.ndarray, centre_b: np.ndarray) -> Moments:
    a, b, aa, bb, ab = sums
    safe = np.maximum(n, 1)
    return Moments(
        n, np.where(n > 0, centre_a + a / safe, 0.0), np.where(n > 0, centre_b + b / safe, 0.0), np.maximum(aa - a * a / safe, 0.0), np.maximum(bb - b * b / safe, 0.0), ab - a * b / safe
    )


def matrix_moments(x: np.ndarray) -> Moments:
    """Of every two columns of a matrix with NaN for missing cells; arrays are columns by columns."""
    p = x.shape[1]
    if not len(x):
        return Moments.empty(p, p)
    z, present, centre = _centred(x)
    sums, squares = z.T @ present, (z * z).T @ present
    return _set(present.T @ present, (sums, sums.T, squares, squares.T, z.T @ z), np.broadcast_to(centre[:, None], (p, p)), np.broadcast_to(centre, (p, p)))


def list_moments(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> Moments:
    """Of the pairs (a[k], b[k]) of columns."""
    total = Moments.empty(len(a))
    step = max(1, PAIR_CELLS // max(1, len(a)))
    for at in range(0, len(x), step):
        z, present, centre = _centred(x[at : at + step])
        both = present[:, a] * present[:, b]
        za, zb = z[:, a] * both, z[:, b] * both
        sums = (za.sum(axis=0), zb.sum(axis=0), (za * za).sum(axis=0), (zb * zb).sum(axis=0), (za * zb).sum(axis=0))
        total = total.merged(_set(both.sum(axis=0), sums, centre[a], centre[b]))
    return total


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of doubles as a matrix, NaN for null."""
    if not batch.num_columns:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float, copy=False)


def merged_over(df: DataFrame, moments: Callable[[Iterator[pa.RecordBatch]], Iterator[Moments]], *shape: int) -> Moments:
    """The moments of all rows: ``moments`` makes sets of a task's batches."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.empty(*shape)
        for found in moments(batches):
            total = total.merged(found)
        yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], ["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.empty(*shape)
        for batch in batches:
            for raw in batch.column(0):
                total = total.merged(Moments.unpacked(raw.as_py(), *shape))
        yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], ["part"])

    parts = df.mapInArrow(own, "part binary").repartition(MERGED_PARTS).mapInArrow(merge, "part binary")
    last = parts.repartition(1).mapInArrow(merge, "part binary").collect()  # one row
    return Moments.unpacked(bytes(last[0]["part"]), *shape) if last else Moments.empty(*shape)


def pair_moments(df: DataFrame) -> Moments:
    """Moments of every two columns of a table of doubles, in one scan, whatever their number."""
    p = len(df.columns)
    return merged_over(df, lambda batches: (matrix_moments(matrix_of(b)) for b in batches), p, p)
