"""Tables that cut lineage in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its
    own; on a cluster that raises, as executors would write where nobody else reads."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        place = tempfile.mkdtemp(prefix="colsight-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


_held: list[dict] = []


def held_by_worker(memory: dict) -> dict:
    """Registers what a Python worker keeps from task to task, so that other operators' tasks can free it."""
    _held.append(memory)
    return memory


def free_held() -> None:
    """Drops what earlier tasks of other operators kept in this Python worker, and gives the memory back. For tasks that
    need much memory themselves: Spark uses workers again."""
    kept = [memory for memory in _held if memory]
    for memory in kept:
        memory.clear()
    if kept:
        give_back()


def give_back() -> None:
    """Returns this Python worker's free memory to the system: Spark keeps workers, and with them what their heaps hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: the memory is free, if not given back
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that frees what other operators kept in its worker, and at its end gives back what it took itself."""

    def task(batches: Iterator) -> Iterator:
        free_held()
        yield from run(batches)
        give_back()

    return task


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; a lost executor costs nothing that is written there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_removed(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the tables that ``cut`` wrote inside: for work whose result has been written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        del _written[before:]


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names with as many underscores in front as make them free among the taken ones, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name in used:
            name = f"_{name}"
        used.add(name)
        out.append(name)
    return out


class Links:
    """Union-find over the numbers 0..n-1 of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, deeper := up[up]):
            up = deeper
        self.up = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i] for all i: smaller roots win, until nothing changes."""
        while len(a):
            up = self.roots()
            x, y = up[a], up[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            nodes, ends = np.unique(f[["u", "v"]].to_numpy(np.int64), return_inverse=True)
            links = Links(len(nodes))
            ends = ends.reshape(-1, 2)
            links.join(ends[:, 0], ends[:, 1])
            root = links.roots()
            own = root != np.arange(len(nodes))
            yield pd.DataFrame({"u": nodes[own], "v": nodes[root[own]]})


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of the edges, by alternating large and
    small stars; both columns long. Nodes without an edge to another node, and null ends, are left out.

    Each round is two joins with map-side minima, written to the shared folder. Batches are first contracted to stars.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    e = cut(e.mapInPandas(_stars, "u long, v long").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
