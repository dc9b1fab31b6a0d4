"""Exact ranks over many columns at once, without a one-task sort.

Input is a *count table* ``(pos, value, cnt, ...)`` with one row per distinct
value of each column ``pos``. Collapsing to distinct values first (a ``groupBy``
with map-side combine) means that a value held by a third of all rows is one row
here. The values of a column are then cut into buckets of about equal numbers of
distinct values; a running sum inside each bucket plus the sum of all earlier
buckets gives, for every value, the number of rows strictly before it.

The bucket of a value depends only on the value and on split points held by the
driver, so a lost task recomputes exactly the same buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.tables import per_column, small_table

# Distinct values one window task sorts, and the most buckets of one column. The
# broadcast split table has at most MAX_BUCKETS rows per column.
BUCKET_VALUES = 250_000
MAX_BUCKETS = 10_000
SPLIT_SAMPLE = 200


def long_form(
    df: DataFrame, cells: dict[int, Column], carried: dict[int, dict[str, Column]] | None = None
) -> DataFrame:
    """Unpivot one-typed cells to ``(pos, value, carried...)``; one scan, no shuffle."""
    rows = [
        F.struct(
            F.lit(pos).alias("pos"), cell.alias("value"),
            *[c.alias(n) for n, c in (carried or {}).get(pos, {}).items()],
        )
        for pos, cell in cells.items()
    ]
    return df.select(F.inline(F.array(*rows)))


def count_values(long: DataFrame, weight: Column | None = None, **sums: Column) -> DataFrame:
    """Distinct non-null values per column with their row counts."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("pos", "value")
        .agg(n.alias("cnt"), *[F.sum(c).alias(name) for name, c in sums.items()])
    )


def hold(df: DataFrame) -> DataFrame:
    """Cache for several passes; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def column_sizes(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """pos -> (rows, distinct values); one small row per column reaches the driver."""
    found = counts.groupBy("pos").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("d"))
    return {r["pos"]: (r["n"], r["d"]) for r in found.collect()}


def _bucket_of(value: Column, splits: Column, steps: Iterable[int]) -> Column:
    """Number of split points below ``value``: a binary search over a sorted array."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(splits, at + step - 1) < value, at + step).otherwise(at),
    )


def with_buckets(
    counts: DataFrame, sizes: dict[int, tuple[int, int]], bucket_values: int = BUCKET_VALUES
) -> DataFrame:
    """Add ``bucket``: value ranges of each column with about equally many distinct values."""
    spark = counts.sparkSession
    widest = max((d for _, d in sizes.values()), default=0)
    buckets = min(MAX_BUCKETS, math.ceil(widest / bucket_values)) if widest else 1
    if buckets <= 1:
        return counts.withColumn("bucket", F.lit(0))
    # split points need not be exact: a hash sample of the distinct values balances well
    every = max(1, widest // (buckets * SPLIT_SAMPLE))
    sample = counts.where(F.pmod(F.xxhash64("value"), F.lit(every)) == 0)
    cuts = [i / buckets for i in range(1, buckets)]
    splits = sample.groupBy("pos").agg(
        F.percentile_approx("value", cuts, max(1_000, 10 * buckets)).alias("splits")
    )
    kind = counts.schema["value"].dataType.simpleString()
    known = small_table(spark, 
        [(r["pos"], sorted(set(r["splits"]))) for r in splits.collect()],
        f"pos int, splits array<{kind}>",
    )
    steps = [1 << b for b in range(buckets.bit_length(), -1, -1)]
    return counts.join(F.broadcast(known), "pos", "left").withColumn(
        "bucket", F.coalesce(_bucket_of(F.col("value"), F.col("splits"), steps), F.lit(0))
    ).drop("splits")


def with_rows_before(
    counts: DataFrame,
    sizes: dict[int, tuple[int, int]] | None = None,
    bucket_values: int = BUCKET_VALUES,
) -> DataFrame:
    """Add ``before``: how many rows of the same column hold a smaller value.

    ``counts`` is read up to three times; hold it first when it is costly.
    """
    sizes = sizes or column_sizes(counts)
    placed = with_buckets(counts, sizes, bucket_values)
    upto = Window.partitionBy("pos", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum("cnt").over(upto) - F.col("cnt")
    if max((d for _, d in sizes.values()), default=0) <= bucket_values:
        return placed.withColumn("before", within).drop("bucket")
    # at most columns x MAX_BUCKETS rows
    earlier = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        placed.groupBy("pos", "bucket")
        .agg(F.sum("cnt").alias("held"))
        .withColumn("start", F.sum("held").over(earlier) - F.col("held"))
        .drop("held")
    )
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(starts), ["pos", "bucket"])
        .withColumn("before", F.col("within") + F.col("start"))
        .drop("within", "start", "bucket")
    )


def average_rank() -> Column:
    """1-based rank of a value, ties sharing their mean rank."""
    return F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)


def quantile_aggs(n: Column, points: dict[str, float]) -> list[Column]:
    """Aggregates that read the two order statistics around each quantile."""
    out = []
    for name, q in points.items():
        at = (n - F.lit(1)) * F.lit(q)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
            out.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{side}"))
    return out


def interpolated(name: str, n: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of ``quantile_aggs``."""
    at = (n - F.lit(1)) * F.lit(q)
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    return lo + (hi - lo) * (at - F.floor(at))


def exact_quantiles(ranked: DataFrame, points: dict[str, float], extra: Iterable[Column] = ()) -> DataFrame:
    """``(pos, n, <points>, <extra>)`` with linear interpolation.

    ``ranked`` must carry the column size ``n``; ``extra`` are further aggregates
    taken in the same pass.
    """
    extra = list(extra)
    row = ranked.groupBy("pos").agg(F.max("n").alias("n"), *quantile_aggs(F.col("n"), points), *extra)
    kept = [c for c in row.columns if not any(c in (f"{p}_lo", f"{p}_hi") for p in points)]
    return row.select(*kept, *[interpolated(p, F.col("n"), q).alias(p) for p, q in points.items()])


def with_sizes(ranked: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Attach the column size ``n``."""
    # coalesce keeps the optimizer from copying the lookup into every aggregate below
    n = per_column({pos: n for pos, (n, _) in sizes.items()}, "bigint")
    return ranked.withColumn("n", F.coalesce(n, F.lit(0)))


# ----- selection without sorting ---------------------------------------------

SELECT_SPLITS = 1_024
SELECT_ROWS = 4_000


@dataclass
class Extent:
    """What selection needs to know of a column beforehand: rows, stored rows, bounds."""

    n: int
    stored: int
    lo: float
    hi: float


def extents(weighted: DataFrame) -> dict[int, Extent]:
    found = weighted.groupBy("pos").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("stored"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return {r["pos"]: Extent(r["n"], r["stored"], float(r["lo"]), float(r["hi"])) for r in found.collect()}


@dataclass
class Bracket:
    """A range of values that holds a wanted rank: its real ends, rows below it, stored rows inside."""

    lo: float
    hi: float
    below: int
    stored: int


def order_statistics(
    weighted: DataFrame, ranks: dict[int, set[int]], known: dict[int, Extent] | None = None, passes: list[str] | None = None
) -> dict[tuple[int, int], float]:
    """Exact values at 0-based ranks of each column, without a sort.

    ``weighted`` is ``(pos, value, cnt)``; values may repeat. A mergeable quantile sketch cuts the values into parts of
    about equal numbers, whatever their distribution; one pass counts every part exactly and so finds the one that holds
    a rank; a part of at most SELECT_ROWS is read out. Up to four million stored values that is three passes; beyond it
    the part is cut again. A value that is a cut is a part of its own, so each round leaves less. ``passes``, if given,
    is told of each pass.
    """
    spark = weighted.sparkSession
    passes = [] if passes is None else passes
    known = known or extents(weighted)
    found: dict[tuple[int, int], float] = {}
    open_ = {(pos, rank): Bracket(e.lo, e.hi, 0, e.stored) for pos, e in known.items() for rank in ranks.get(pos, ())}

    def close() -> None:
        for key in [k for k, b in open_.items() if b.lo == b.hi]:
            found[key] = open_.pop(key).lo

    close()
    while open_:
        few = {k for k, b in open_.items() if b.stored <= SELECT_ROWS}
        wanted = few or set(open_)
        parts = {key: at for at, key in enumerate(sorted({(k[0], open_[k].lo, open_[k].hi) for k in wanted}))}
        table = small_table(spark, [(at, *key) for key, at in parts.items()], "part int, pos int, lo double, hi double")
        inside = weighted.join(F.broadcast(table), "pos").where(F.col("value").between(F.col("lo"), F.col("hi")))
        cell = F.col("value")
        if not few:
            passes.append("sketch")
            cuts = [i / SELECT_SPLITS for i in range(1, SELECT_SPLITS)]
            sketch = inside.groupBy("part").agg(F.percentile_approx("value", cuts, 10 * SELECT_SPLITS).alias("splits"))
            rows = [(r["part"], sorted(set(r["splits"]))) for r in sketch.collect()]
            inside = inside.join(F.broadcast(small_table(spark, rows, "part int, splits array<double>")), "part")
            steps = [1 << b for b in range(SELECT_SPLITS.bit_length(), -1, -1)]
            inside = inside.withColumn("at", _bucket_of(F.col("value"), F.col("splits"), steps))
            cell = 2 * F.col("at") + F.coalesce(F.get("splits", F.col("at")) == F.col("value"), F.lit(False)).cast("int")
        passes.append("read" if few else "count")
        cells = inside.groupBy("part", cell.alias("cell")).agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("cnt").alias("cnt"),
        )
        grouped: dict[int, list[tuple]] = {}
        for r in cells.collect():
            grouped.setdefault(r["part"], []).append((r["lo"], r["hi"], r["rows"], r["cnt"]))
        for key in wanted:
            bracket = open_[key]
            below = bracket.below
            for lo, hi, rows, cnt in sorted(grouped[parts[key[0], bracket.lo, bracket.hi]]):
                if key[1] < below + cnt:
                    open_[key] = Bracket(lo, hi, below, rows)
                    break
                below += cnt
        close()
    return found


def median_ranks(n: int) -> tuple[int, int]:
    return (n - 1) // 2, n // 2


def quantile_ranks(n: int, q: float) -> tuple[int, int]:
    """0-based positions of the order statistics around a quantile."""
    at = (n - 1) * q
    return math.floor(at), math.ceil(at)


def quantile_from(at: dict[tuple[int, int], float], pos: int, n: int, q: float) -> float:
    """Linear interpolation between selected order statistics."""
    lo, hi = (at[pos, rank] for rank in quantile_ranks(n, q))
    return lo + (hi - lo) * ((n - 1) * q - math.floor((n - 1) * q))


def medians(weighted: DataFrame, known: dict[int, Extent] | None = None) -> dict[int, float]:
    """The exact median of each column."""
    known = known or extents(weighted)
    at = order_statistics(weighted, {pos: set(median_ranks(e.n)) for pos, e in known.items()}, known)
    return {pos: sum(at[pos, rank] for rank in median_ranks(e.n)) / 2.0 for pos, e in known.items()}
