"""Row segments: scaling, k-means with a chosen k, silhouettes, 2-D projection."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.tables import small_table
from colsight.operators.clustering import Fit, fit_groups, nearest, spread_rows
from colsight.operators.kinds import ColumnKind, of_kind, typed_cell
from colsight.operators.ranking import hold

# --- fixed values: limits, seed, labels and reasons --------------------------
K_MIN, K_MAX = 2, 8
SEED = 42
MIN_ROWS = 20
MIN_FEATURES = 2
TOP_FEATURES = 3
LABELS = string.ascii_uppercase
FEW_ROWS = "Need at least {} rows to find meaningful clusters; this dataset has {}."
FEW_FEATURES = "Need at least {} numeric columns to cluster; this dataset has {}."
FEW_COMPLETE = "After dropping rows with any missing numeric value, only {} rows remain. Need at least {}."
NO_FIT = "Could not fit any k between K_MIN and K_MAX."
# --- end of fixed values -----------------------------------------------------

MAX_ITERATIONS = 100
RESTARTS = 3
# Stop once no centre moves further than this many standard deviations.
CENTER_SHIFT = 1e-4
# All-pairs Euclidean silhouettes, on request, are for tables of up to this many rows (one bounded matrix per task).
EXACT_SILHOUETTE_ROWS = 4_000
GRID = 50

CANDIDATE_SCHEMA = "k int, score double, metric string, converged boolean, rounds int"
CELL_SCHEMA = "cluster int, cell_x int, cell_y int, n bigint, x double, y double"
CLUSTER_SCHEMA = "cluster int, label string, size bigint, size_pct double"
FEATURE_SCHEMA = "cluster int, rank int, feature string, center_value double, deviation double"
PROJECTION_SCHEMA = "x double, y double, cluster int"
SUMMARY_SCHEMA = (
    "k int, silhouette double, metric string, n_features int, n_rows bigint, "
    "pca_variance_1 double, pca_variance_2 double, skipped_reason string, converged boolean, rounds int"
)


@dataclass
class Segments:
    summary: DataFrame
    candidates: DataFrame
    clusters: DataFrame
    features: DataFrame
    projection: DataFrame
    cells: DataFrame


@dataclass
class Scaling:
    names: list[str]
    n: int
    means: np.ndarray
    sd_population: np.ndarray
    sd_sample: np.ndarray


def complete_rows(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Numeric columns as c0, c1, ... over rows complete in all of them."""
    return df.select(*[typed_cell(df, k).alias(f"c{i}") for i, k in enumerate(of_kind(kinds, "numeric"))]).na.drop()


def fit_scaling(rows: DataFrame, names: list[str]) -> Scaling:
    """Mean and spread of every feature in one pass; a constant feature keeps scale 1."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in rows.columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"p_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    r = rows.agg(*aggs).first()

    def pick(prefix: str, empty: float) -> np.ndarray:
        found = np.array([r[f"{prefix}_{c}"] if r[f"{prefix}_{c}"] is not None else empty for c in rows.columns])
        return np.where(found == 0, 1.0, found) if prefix != "m" else found

    return Scaling(names, r["n"], pick("m", 0.0), pick("p", 1.0), pick("s", 1.0))


def scaled_cells(scaling: Scaling) -> list[Column]:
    return [
        ((F.col(f"c{i}") - F.lit(float(m))) / F.lit(float(s))).alias(f"z{i}")
        for i, (m, s) in enumerate(zip(scaling.means, scaling.sd_population))
    ]


def zscores(df: DataFrame, kinds: list[ColumnKind], key: list[str] | None = None) -> DataFrame:
    """z-scores (population sd) of the numeric columns over complete rows, keys kept."""
    numeric = of_kind(kinds, "numeric")
    cells = [typed_cell(df, k).alias(f"c{i}") for i, k in enumerate(numeric)]
    rows = df.select(*(key or []), *cells).na.drop(subset=[f"c{i}" for i in range(len(numeric))])
    scaling = fit_scaling(rows.select(*[f"c{i}" for i in range(len(numeric))]), [k.name for k in numeric])
    return rows.select(*(key or []), *[z.alias(f"z_{k.name}") for z, k in zip(scaled_cells(scaling), numeric)])


# ----- silhouettes -----------------------------------------------------------


def silhouette_squared(labelled: DataFrame, column: str) -> float:
    """Mean squared-Euclidean silhouette over all rows; linear cost."""
    return float(ClusteringEvaluator(predictionCol=column, featuresCol="features").evaluate(labelled))


def silhouette_euclidean(labelled: DataFrame, features: list[str], columns: list[str]) -> dict[str, float]:
    """Mean Euclidean silhouette of a bounded table, for several labellings at once.

    The table goes to every task as one matrix (at most EXACT_SILHOUETTE_ROWS
    rows); each task compares its own rows with it, block by block.
    """
    table = labelled.select(*features, *columns).limit(EXACT_SILHOUETTE_ROWS + 1).toPandas()
    if len(table) > EXACT_SILHOUETTE_ROWS:
        raise ValueError("too many rows for the all-pairs silhouette")
    points = table[features].to_numpy(float)
    groups = {}
    for c in columns:
        ids, index, sizes = np.unique(table[c].to_numpy(), return_inverse=True, return_counts=True)
        groups[c] = (ids, np.eye(len(ids))[index], sizes)

    def score(batches):
        for block in batches:
            mine = block[features].to_numpy(float)
            gaps = np.zeros((len(mine), len(points)))
            for f in range(mine.shape[1]):  # direct differences lose no digits
                gaps += (mine[:, f, None] - points[None, :, f]) ** 2
            distance, row, out = np.sqrt(gaps), np.arange(len(mine)), {}
            for c, (ids, member, sizes) in groups.items():
                own = np.searchsorted(ids, block[c].to_numpy())
                sums = distance @ member
                inside = sums[row, own] / np.maximum(sizes[own] - 1, 1)
                others = sums / sizes
                others[row, own] = np.inf
                nearest = others.min(axis=1)
                top = np.maximum(inside, nearest)
                out[c] = np.where((sizes[own] > 1) & (top > 0), (nearest - inside) / np.where(top > 0, top, 1.0), 0.0)
            yield pd.DataFrame(out)

    usable = [c for c in columns if len(groups[c][0]) > 1]
    if not usable:
        return {}
    schema = ", ".join(f"{c} double" for c in columns)
    means = labelled.select(*features, *columns).mapInPandas(score, schema).agg(*[F.avg(c).alias(c) for c in usable])
    return means.first().asDict()


# ----- k-means ---------------------------------------------------------------


def score_fits(points: DataFrame, columns: list[str], fits: dict[int, Fit], metric: str) -> dict[int, float]:
    """The silhouette of each fit with more than one group. ``centroid`` (Euclidean distances to centres, found with the
    fits) and ``squared_euclidean`` are linear in the rows; ``euclidean`` compares all pairs of a bounded table."""
    usable = {k: f for k, f in fits.items() if (f.sizes > 0).sum() > 1}
    if metric == "centroid":
        return {k: f.separation for k, f in usable.items()}
    labelled = points.select("features", *columns, *[nearest(columns, f.centers).alias(f"k{k}") for k, f in usable.items()])
    if metric == "squared_euclidean":
        return {k: silhouette_squared(labelled, f"k{k}") for k in usable}
    if metric == "euclidean":
        scores = silhouette_euclidean(labelled, columns, [f"k{k}" for k in usable])
        return {k: scores[f"k{k}"] for k in usable if scores.get(f"k{k}") is not None}
    raise ValueError(f"unknown metric: {metric}")


def choose_k(points: DataFrame, scaling: Scaling, metric: str = "centroid"):
    """Fit every k at once, score each, keep the best (the smaller k on ties): (fit, score, candidates)."""
    columns = [f"z{i}" for i in range(len(scaling.names))]
    ks = list(range(K_MIN, min(K_MAX, scaling.n - 1) + 1))
    fits = fit_groups(points, columns, ks, RESTARTS, MAX_ITERATIONS, CENTER_SHIFT, SEED)
    scores = score_fits(points, columns, fits, metric)
    candidates = [(k, scores[k], metric, fits[k].converged, fits[k].rounds) for k in sorted(scores)]
    if not candidates:
        return None, None, []
    k, score, *_ = max(candidates, key=lambda c: (round(c[1], 12), -c[0]))
    return fits[k], score, candidates


def canonical_order(sizes: dict[int, int], centers: list[np.ndarray]) -> list[int]:
    """New id of every raw cluster: larger first, then by centre."""
    order = sorted(range(len(centers)), key=lambda c: (-sizes.get(c, 0), tuple(centers[c])))
    new = [0] * len(centers)
    for fresh, raw in enumerate(order):
        new[raw] = fresh
    return new


def cluster_label(cluster: Column) -> Column:
    letters = F.array(*[F.lit(f"Group {c}") for c in LABELS])
    return F.when(cluster < len(LABELS), F.get(letters, cluster)).otherwise(
        F.concat(F.lit("Group "), (cluster + 1).cast("string"))
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Size and share of every cluster."""
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = labelled.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    joined = sizes.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return joined.select(
        F.col("cluster").cast("int"), cluster_label(F.col("cluster")).alias("label"), "size",
        (F.col("size") / F.col("n")).alias("size_pct"),
    )


def distinguishing_features(labelled: DataFrame, features: dict[str, str], limit: int | None = TOP_FEATURES) -> DataFrame:
    """Centre of each feature per cluster and its distance from the overall mean in sample sd.

    ``features`` maps a column to its shown name. Keeps the ``limit`` largest.
    """
    def spread(frame: DataFrame, aggs: dict[str, str], *keys: str) -> DataFrame:
        cells = [
            F.struct(F.lit(shown).alias("feature"), *[F.col(f"{a}{i}").alias(out) for a, out in aggs.items()])
            for i, shown in enumerate(features.values())
        ]
        return frame.select(*keys, F.inline(F.array(*cells)))

    centers = labelled.groupBy("cluster").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)])
    overall = labelled.agg(*[
        a for i, c in enumerate(features) for a in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))
    ])
    left = spread(centers, {"m": "center_value"}, "cluster")
    right = spread(overall, {"m": "mean", "s": "sd"})
    sd = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    deviation = (F.col("center_value") - F.col("mean")) / sd
    order = Window.partitionBy("cluster").orderBy(F.abs("deviation").desc(), "feature")
    out = left.join(F.broadcast(right), "feature").select(
        F.col("cluster").cast("int"), "feature", "center_value", deviation.alias("deviation")
    ).withColumn("rank", F.row_number().over(order))
    out = out.select("cluster", "rank", "feature", "center_value", "deviation")
    return out if limit is None else out.where(F.col("rank") <= limit)


# ----- projection ------------------------------------------------------------


def fit_projection(points: DataFrame) -> tuple[np.ndarray, list[float]]:
    """Two principal directions (largest loading positive) and their variance shares."""
    fit = PCA(k=2, inputCol="features", outputCol="projected").fit(points)
    axes = np.array(fit.pc.toArray())
    for a in range(axes.shape[1]):
        if axes[np.argmax(np.abs(axes[:, a])), a] < 0:
            axes[:, a] = -axes[:, a]
    return axes, [float(v) for v in fit.explainedVariance.toArray()]


def projected(points: DataFrame, axes: np.ndarray) -> DataFrame:
    """Coordinates by plain column arithmetic; ``points`` carries z0, z1, ..."""
    def along(axis: int) -> Column:
        total = F.lit(0.0)
        for i, weight in enumerate(axes[:, axis]):
            total = total + F.lit(float(weight)) * F.col(f"z{i}")
        return total

    return points.withColumn("x", along(0)).withColumn("y", along(1))


def projection_cells(spots: DataFrame, grid: int = GRID) -> DataFrame:
    """Rows and mean place of each cluster in each cell of a grid over all points: at most grid squared rows a cluster."""
    ends = spots.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str) -> Column:
        share = F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}"))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * grid), F.lit(grid - 1)).cast("int")

    placed = spots.withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one")
    return placed.groupBy("cluster", cell("x").alias("cell_x"), cell("y").alias("cell_y")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


# ----- all of it -------------------------------------------------------------


def skipped(df: DataFrame, reason: str) -> Segments:
    spark = df.sparkSession
    return Segments(
        small_table(spark, [(None, None, None, None, None, None, None, reason, None, None)], SUMMARY_SCHEMA),
        small_table(spark, [], CANDIDATE_SCHEMA), small_table(spark, [], CLUSTER_SCHEMA),
        small_table(spark, [], FEATURE_SCHEMA), small_table(spark, [], PROJECTION_SCHEMA), small_table(spark, [], CELL_SCHEMA),
    )


def segment(df: DataFrame, kinds: list[ColumnKind], metric: str = "centroid") -> Segments:
    """Group complete rows; a table that does not qualify yields only a reason.

    ``metric`` chooses k, in the same way at every size: ``centroid``, ``squared_euclidean``, or ``euclidean``, which
    raises above EXACT_SILHOUETTE_ROWS.
    """
    numeric = of_kind(kinds, "numeric")
    total = df.count()
    if total < MIN_ROWS:
        return skipped(df, FEW_ROWS.format(MIN_ROWS, total))
    if len(numeric) < MIN_FEATURES:
        return skipped(df, FEW_FEATURES.format(MIN_FEATURES, len(numeric)))
    rows = complete_rows(df, kinds)
    names = [k.name for k in numeric]
    scaling = fit_scaling(rows, names)
    if scaling.n < MIN_ROWS:
        return skipped(df, FEW_COMPLETE.format(scaling.n, MIN_ROWS))
    return _segment_rows(rows, scaling, metric)


def _segment_rows(rows: DataFrame, scaling: Scaling, metric: str) -> Segments:
    spark = rows.sparkSession
    z = [f"z{i}" for i in range(len(scaling.names))]
    assembler = VectorAssembler(inputCols=z, outputCol="features")
    points = hold(assembler.transform(spread_rows(rows, scaling.n).select("*", *scaled_cells(scaling))))
    try:
        model, score, candidates = choose_k(points, scaling, metric)
        if model is None:
            return skipped(rows, NO_FIT)
        new = canonical_order(dict(enumerate(model.sizes)), list(model.centers))
        labelled = points.withColumn("cluster", F.get(F.array(*[F.lit(i) for i in new]), nearest(z, model.centers)))
        clusters = cluster_sizes(labelled).orderBy("cluster").collect()  # at most K_MAX rows
        features = distinguishing_features(labelled, {f"c{i}": n for i, n in enumerate(scaling.names)}).collect()
        axes, shares = fit_projection(points)
        spots = projected(labelled, axes).select("x", "y", F.col("cluster").cast("int").alias("cluster"))  # every row, lazily
        cells = small_table(spark, projection_cells(spots).collect(), CELL_SCHEMA)
    finally:
        points.unpersist()
    summary = (len(new), score, candidates[0][2], len(scaling.names), scaling.n, *(shares + [0.0])[:2], None, model.converged, model.rounds)
    return Segments(
        small_table(spark, [summary], SUMMARY_SCHEMA), small_table(spark, candidates, CANDIDATE_SCHEMA),
        small_table(spark, clusters, CLUSTER_SCHEMA), small_table(spark, sorted(features), FEATURE_SCHEMA),
        spots, cells,
    )
