"""Near copies among embeddings: int8 tile products with error bounds, then full precision where they leave doubt.

A unit vector x is kept as s q + e with q of int8 and s one scale; |s q| and |e| are known. For two of them
x y = s s' q q' + s q e' + e y, so |x y - s s' q q'| <= |s q| |e'| + |e|. Products of int8 vectors are exact. Only pairs whose bound reaches the threshold are recomputed in double precision.

Equal vectors are one row with a count. Every tile of rows meets every later tile; a pair of tiles returns counts and
the stars of its links, never its pairs. The work is quadratic in the number of distinct vectors, as all exact products are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.llm.shared import Links, components, cut

TILE_ROWS = 4096
"""Aimed-at rows of a tile."""
EXACT = 1024
"""Dimensions of int8 whose product is exact in float32; longer vectors are multiplied in parts, summed in float64."""
SLACK = 1e-6
"""Added to every bound for rounding of the bound itself."""


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |s q|, |e|) of the rows of unit vectors."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def _tile_links(threshold: float):
    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        if not len(left) or not len(right):
            return
        sides = []
        for f in (left, right):
            x = np.array(f["embedding"].to_list(), np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            sides.append((x, norm, *quantise(x / norm[:, None])))
        (x, nx, q, s, big, err), (y, ny, r, t, _, lost) = sides
        y8, node = r.astype(np.float32).T, np.concatenate((left["node"], right["node"]))
        links, found = Links(len(x) + len(y)), np.zeros(len(x) + len(y), np.int64)
        copies = [f["copies"].to_numpy(np.int64) for f in (left, right)]
        if same:
            links.join(np.arange(len(x)), np.arange(len(x), 2 * len(x)))
        for i in range(0, len(x), 512):
            b = slice(i, i + 512)
            about = sum((q[b, k : k + EXACT].astype(np.float32) @ y8[k : k + EXACT]).astype(np.float64) for k in range(0, q.shape[1], EXACT)) * s[b, None] * t[None, :]
            about += big[b, None] * lost[None, :] + err[b, None] + SLACK
            rows, cols = np.nonzero(about >= threshold)
            if same:
                rows, cols = rows[cols > rows + i], cols[cols > rows + i]
            for k in range(0, len(rows), 1 << 15):
                u, v = rows[k : k + (1 << 15)] + i, cols[k : k + (1 << 15)]
                near = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v]) >= threshold
                u, v = u[near], v[near]
                np.add.at(found, u, copies[1][v])
                np.add.at(found, v + len(x) * (not same), copies[0][u])
                links.join(u, v + len(x))
        root = links.roots()
        hit = np.flatnonzero((found > 0) | (root != np.arange(len(root))))
        out = pd.DataFrame({"node": node[hit], "other": node[root[hit]], "links": found[hit]})
        if len(out):
            yield out

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pair of tiles; a pair's rows are held together."""
        held = None
        for f in frames:
            f = f if held is None else pd.concat((held, f), ignore_index=True)
            keys = f["pair"].to_numpy()
            last = int(np.flatnonzero(keys == keys[-1])[0]) if len(f) else 0
            yield from whole(f.iloc[:last])
            held = f.iloc[last:]
        if held is not None:
            yield from whole(held)

    def whole(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, one in f.groupby("pair", sort=False):
            a, b = int(one["low"].iloc[0]), int(one["high"].iloc[0])
            left = one[one["tile"] == a]
            yield from run(left, left if a == b else one[one["tile"] == b], a == b)

    return tiles


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``df``: the id, ``n_links`` (other rows with a cosine of at least ``threshold``),
    ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (the id is that one).

    Null, empty or zero vectors and those with null or non-finite parts link with nothing; vectors of different lengths
    do not link. Equal vectors link with each other. Rows with a null id or one that repeats: a null id links with
    nothing; equal ids are one node whose rows count as links of each other only if their vectors link. Further columns
    are ignored.
    """
    single = df.select(vector_col).schema[0].dataType == T.ArrayType(T.FloatType())
    kept = "array<float>" if single else "array<double>"  # floats become doubles inside the tiles, without loss
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kept).alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    classes = cut(rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    tiles = -(-classes.count() // TILE_ROWS)
    placed = classes.withColumns({"size": F.size("embedding"), "tile": F.pmod(F.xxhash64("node"), F.lit(max(tiles, 1))).cast("int")})
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(tiles, 1) - 1))))
    placed = placed.select("node", "copies", "embedding", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), F.concat_ws("-", "size", F.least("tile", "other"), F.greatest("tile", "other")).alias("pair"))
    compared = placed.repartition("pair").sortWithinPartitions("pair")
    found = cut(compared.mapInPandas(_tile_links(threshold), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found, "node", "other")
    named = rows.join(classes, "embedding", "left").join(links, "node", "left").join(reached, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return named.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
