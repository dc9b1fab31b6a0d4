"""k-means for every number of groups and every start at once.

All models move together: one pass over the rows assigns them to the centres of every model that still moves and adds up
the rows of each centre, so a round is one job whatever the number of models. Starts come from a bounded set of distinct
points; they only say where to begin, every round reads every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsight.operators.moments import matrix_of

START_POINTS = 2_000
"""Distinct points, those with the smallest hashes, from which starts are drawn."""
BLOCK_ROWS = 2_048
TASK_ROWS, LEAST_ROWS = 200_000, 2_000
"""Rows of a task at most, and fewer of them only down to so many, if cores are free."""


@dataclass
class Fit:
    """Centres and rows of each; ``separation`` is the mean over all rows of (b - a) / b, with a and b the distances to
    the nearest and the second nearest centre: a silhouette against centres, linear in the rows."""

    k: int
    centers: np.ndarray
    sizes: np.ndarray
    cost: float
    rounds: int
    converged: bool
    separation: float = 0.0


def spread_rows(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows dealt evenly to tasks: files in few row groups would leave every round to few cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, n // LEAST_ROWS), -(-n // TASK_ROWS)))


def start_points(points: DataFrame, columns: list[str]) -> np.ndarray:
    """At most START_POINTS distinct points, the same ones under any partitioning."""
    names = [*columns, "hash"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(columns)))
        hashes = np.zeros(0, np.int64)
        for batch in batches:
            hashes = np.concatenate((hashes, batch.column(len(columns)).to_numpy()))
            held = np.concatenate((held, matrix_of(batch.select(columns))))
            hashes, first = np.unique(hashes, return_index=True)
            hashes, held = hashes[:START_POINTS], held[first[:START_POINTS]]
        yield pa.RecordBatch.from_arrays([*(pa.array(held[:, i]) for i in range(len(columns))), pa.array(hashes)], names)

    schema = ", ".join([*(f"{c} double" for c in columns), "hash long"])
    # adding 0 makes both zeros one value
    found = points.select(*columns, F.xxhash64(*(F.col(c) + F.lit(0.0) for c in columns)).alias("hash")).mapInArrow(own, schema)
    rows = found.dropDuplicates(["hash"]).orderBy("hash").limit(START_POINTS).toPandas()
    return rows[columns].to_numpy(float)


def spread_start(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k points of the sample, each drawn with chances that grow with the squared distance from those drawn before."""
    chosen = [int(rng.integers(len(sample)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(sample), p=gap / gap.sum())))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centers.T) + (centers * centers).sum(axis=1)[None, :], 0.0)


def _summed(points: DataFrame, columns: list[str], size: int, width: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The total of every task's ``size`` rows of ``width`` sums; ``add`` adds a block of rows to them."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, width))
        for batch in batches:
            cells = matrix_of(batch)
            for at in range(0, len(cells), BLOCK_ROWS):
                add(sums, cells[at : at + BLOCK_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *(pa.array(sums[:, k]) for k in range(width))], ["at", *(f"s{k}" for k in range(width))])

    schema = ", ".join(["at long", *(f"s{k} double" for k in range(width))])
    rows = points.select(*columns).mapInArrow(own, schema).groupBy("at").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
    found = np.zeros((size, width))
    for r in rows.collect():
        found[r["at"]] = r[1:]
    return found


def _members(points: DataFrame, columns: list[str], models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, summed points) of each centre of all models, end to end; the first of equally near centres counts."""
    begin = np.cumsum([0, *(len(m) for m in models)])
    every = np.concatenate(models)
    size, squares = np.diff(begin), (every * every).sum(axis=1)[:, None]

    def add(sums: np.ndarray, x: np.ndarray) -> None:
        gaps = squares - 2.0 * (every @ x.T)  # less the point's own square, which all centres share
        own = gaps == np.repeat(np.minimum.reduceat(gaps, begin[:-1], axis=0), size, axis=0)
        if own.sum() > len(size) * len(x):
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                own[a:b] &= np.cumsum(own[a:b], axis=0) == 1
        sums += own.astype(float) @ np.column_stack([np.ones(len(x)), x])

    found = _summed(points, columns, len(every), 1 + every.shape[1], add)
    return found[:, 0], found[:, 1:]


def _judged(points: DataFrame, columns: list[str], models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, summed squared distance, summed separation) of each centre of all models, end to end."""
    begin = np.cumsum([0, *(len(m) for m in models)])
    every = np.concatenate(models)

    def add(sums: np.ndarray, x: np.ndarray) -> None:
        gaps = _distances(x, every)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            near = gaps[:, a:b].argmin(axis=1)
            two = np.sqrt(np.partition(gaps[:, a:b], 1, axis=1)[:, :2]) if b - a > 1 else np.zeros((len(x), 2))
            apart = np.divide(two[:, 1] - two[:, 0], two[:, 1], out=np.zeros(len(x)), where=two[:, 1] > 0)
            cost = ((x - every[a:b][near]) ** 2).sum(axis=1)
            for k, weight in enumerate([None, cost, apart]):
                sums[a:b, k] += np.bincount(near, weight, b - a)

    found = _summed(points, columns, len(every), 3, add)
    return found[:, 0], found[:, 1], found[:, 2]


def fit_groups(points: DataFrame, columns: list[str], ks: list[int], starts: int, most_rounds: int, shift: float, seed: int) -> dict[int, Fit]:
    """The tightest of several starts for each k; a k above the number of distinct points has none. A model stops when no
    centre moves by more than ``shift``, or not ``converged`` after ``most_rounds``."""
    sample = start_points(points, columns)
    rng = np.random.default_rng(seed)
    keys = [(k, s) for k in ks if k <= len(sample) for s in range(starts)]
    if not keys:
        return {}
    centers = {key: spread_start(sample, key[0], rng) for key in keys}
    rounds, moving = dict.fromkeys(keys, 0), list(keys)
    for _ in range(most_rounds):
        if not moving:
            break
        n, total = _members(points, columns, [centers[key] for key in moving])
        at, still = 0, []
        for key in moving:
            own, sums = n[at : at + key[0]], total[at : at + key[0]]
            at += key[0]
            new = np.where(own[:, None] > 0, sums / np.maximum(own, 1)[:, None], centers[key])
            moved = np.sqrt(((new - centers[key]) ** 2).sum(axis=1)).max()
            centers[key] = new
            rounds[key] += 1
            if moved > shift:
                still.append(key)
        moving = still
    n, cost, apart = _judged(points, columns, [centers[key] for key in keys])
    out: dict[int, Fit] = {}
    at = 0
    for key in keys:
        own = slice(at, at + key[0])
        at += key[0]
        fit = Fit(key[0], centers[key], n[own], float(cost[own].sum()), rounds[key], key not in moving, float(apart[own].sum() / max(n[own].sum(), 1)))
        if key[0] not in out or fit.cost < out[key[0]].cost:
            out[key[0]] = fit
    return out


def nearest(columns: list[str], centers: np.ndarray) -> Column:
    """The number of the nearest centre (the first of equal ones) as a column expression."""
    gaps = []
    for i, center in enumerate(centers):
        total = F.lit(0.0)
        for c, v in zip(columns, center):
            total = total + (F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v)))
        gaps.append(F.struct(total.alias("gap"), F.lit(i).alias("at")))
    return F.array_min(F.array(*gaps))["at"]
