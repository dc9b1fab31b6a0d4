"""Chart-ready derivations of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram_bars(histogram: DataFrame) -> DataFrame:
    """Bin centres and widths."""
    lo, hi = F.col("bin_lo"), F.col("bin_hi")
    return histogram.select("name", "bin", ((lo + hi) / 2).alias("center"), (hi - lo).alias("width"), "cnt")


def cluster_points(cells: DataFrame) -> DataFrame:
    """What a scatter draws: one point per cluster and grid cell, sized by its rows; bounded by the grid."""
    return cells.select("cluster", "x", "y", "n").orderBy("cluster", "x", "y")


def projection_variance(summary: DataFrame) -> DataFrame:
    return summary.select((F.col("pca_variance_1") + F.col("pca_variance_2")).alias("total_variance"))


def matrix_rows(matrix: DataFrame) -> DataFrame:
    """A long correlation matrix as one array per row, gaps as NULL; size is columns squared."""
    cells = F.sort_array(F.collect_list(F.struct("j", "r", "p")))
    return (
        matrix.groupBy("i", "col_i").agg(cells.alias("cells"))
        .select("i", F.col("col_i").alias("column"), F.transform("cells", lambda c: c["r"]).alias("r"),
                F.transform("cells", lambda c: c["p"]).alias("p"))
        .orderBy("i")
    )
