"""Per-column profiles: numeric, categorical, datetime, boolean, unknown.

Plan of the numeric profile, whatever the number of columns:

1. one scan of the data into a count table of distinct values, which is held;
2. counts, moments and extremes from that table;
3. ranks over it: percentiles, Gini and the normality test in one pass;
4. MAD by selection over ``|x - median|``, without another sort;
5. one pass for fences, robust outliers and histogram bins.

Only one small row per column (and up to 40 bins and 50 outliers) passes through
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions import cells
from colsight.functions.tables import per_column, small_table
from colsight.functions.special import francia_p, normal_score
from colsight.operators.kinds import ColumnKind, KINDS, kinds_from_schema, name_column, of_kind, typed_cell
from colsight.operators import ranking

# --- fixed values: profile limits, factors and tables ------------------------
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
MAD_SCALE = 1.4826
ROBUST_FACTOR = 0.6745
ROBUST_CUT = 3.5
FENCE = 1.5
MIN_NORMALITY_ROWS, MIN_NORMALITY_VALUES = 5, 3
MAX_BINS = 40
MIN_BINS = 10
TIE = 0.0005
TOP_VALUES = 5
TOP_OUTLIERS = 50
YEAR_WORDS = ("year", "yr", "fiscal_year", "fy")
YEAR_RANGE = (1800, 2200)
CADENCES = ((1.5, "daily", 1.0), (9.0, "weekly", 7.0), (45.0, "monthly", 30.4375),
            (130.0, "quarterly", 91.3125), (400.0, "yearly", 365.25))
GAP_SLACK = 1.5
NO_NUMBERS = "No numeric values after coercion."
NO_CATEGORIES = "No non-empty categorical values."
NO_DATES = "No parseable dates after coercion."
NO_BOOLEANS = "No recognized boolean values."
UNSUPPORTED = "Type '{}' is not supported in this version."
# --- end of fixed values -----------------------------------------------------

MICROS_PER_DAY = 86_400_000_000.0

NUMERIC_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("position", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("total_rows", "missing")]
    + [T.StructField("missing_pct", T.DoubleType()), T.StructField("count", T.LongType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("mean", "std", "cv", "median", "mad", "iqr", "min", "max", *PERCENTILES,
                  "skew", "kurtosis_excess", "normality_statistic", "normality_p")
    ]
    + [T.StructField("normality_test", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("outlier_iqr_count", "outlier_robust_count")]
    + [T.StructField("gini", T.DoubleType()), T.StructField("zeros_count", T.LongType()),
       T.StructField("format_hint", T.StringType())]
)
UNKNOWN_SCHEMA = (
    "name string, position int, total_rows bigint, missing bigint, missing_pct double, reason string"
)


@dataclass
class Profile:
    """Result tables of one profile run; all are small and keyed by column name."""

    row_count: int
    column_count: int
    numeric: DataFrame
    histogram: DataFrame
    outliers: DataFrame
    categorical: DataFrame
    top_values: DataFrame
    datetime: DataFrame
    boolean: DataFrame
    unknown: DataFrame


def guarded_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def blank_cell(df: DataFrame, kind: ColumnKind) -> Column:
    return cells.is_blank(name_column(kind.name), df.schema[kind.name].dataType)


# ----- numeric ---------------------------------------------------------------


def numeric_counts(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Count table of all numeric columns; the only scan of the data.

    One row ``(pos, NULL, cnt, blanks)`` per column holds its unusable cells.
    """
    long = ranking.long_form(
        df, {k.position: typed_cell(df, k) for k in kinds}, {k.position: {"blank": blank_cell(df, k)} for k in kinds}
    )
    return long.groupBy("pos", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if("blank").alias("blanks")
    )


def numeric_facts(counts: DataFrame) -> DataFrame:
    """Counts, mean and extremes per column, from the count table."""
    v, c = F.col("value"), F.col("cnt")
    usable = F.when(v.isNotNull(), c)
    return counts.groupBy("pos").agg(
        F.sum(c).alias("total_rows"),
        F.sum("blanks").alias("missing"),
        F.coalesce(F.sum(usable), F.lit(0)).alias("count"),
        F.count(v).alias("distinct"),
        F.try_divide(F.sum(v * c), F.sum(usable)).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.sum(F.when(v == 0, c)), F.lit(0)).alias("zeros_count"),
        F.every(v == F.floor(v)).alias("whole"),
    )


def central_moments(counts: DataFrame, means: dict[int, float]) -> DataFrame:
    """Second to fourth sums of deviations per column."""
    d, c = F.col("value") - per_column(means), F.col("cnt")
    return counts.groupBy("pos").agg(
        *[F.sum(F.pow(d, F.lit(float(k))) * c).alias(f"m{k}") for k in (2, 3, 4)]
    )


def shape_statistics(n: int, m2: float, m3: float, m4: float) -> dict[str, float]:
    """Sample sd and bias-corrected skew and excess kurtosis from deviation sums."""
    out = {"std": 0.0, "skew": 0.0, "kurtosis_excess": 0.0}
    if n < 2 or m2 <= 0:
        return out
    out["std"] = (m2 / (n - 1)) ** 0.5
    second = m2 / n
    if n > 2:
        out["skew"] = (m3 / n) / second**1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
    if n > 3:
        excess = (m4 / n) / second**2 - 3.0
        out["kurtosis_excess"] = ((n + 1) * excess + 6.0) * (n - 1) / ((n - 2) * (n - 3))
    return out


def looks_like_years(name: str, whole: bool, lo: float, hi: float) -> bool:
    named = any(word in name.lower() for word in YEAR_WORDS)
    return bool(named and whole and lo >= YEAR_RANGE[0] and hi <= YEAR_RANGE[1])


def gini_sum() -> Column:
    """Sum of position times value over the ranked table (positions from 1)."""
    c, before = F.col("cnt").cast("double"), F.col("before").cast("double")
    return F.sum(F.col("value") * c * (2 * before + c + 1) / F.lit(2.0))


def gini_table(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Gini coefficient of the absolute values of each numeric column."""
    spark = df.sparkSession
    sizes_of = {k.position: F.abs(typed_cell(df, k)) for k in kinds}
    counts = ranking.hold(ranking.count_values(ranking.long_form(df, sizes_of)))
    try:
        sums = ranking.with_rows_before(counts).groupBy("pos").agg(
            F.sum("cnt").cast("double").alias("n"), F.sum(F.col("value") * F.col("cnt")).alias("total"),
            gini_sum().alias("weighted"),
        ).collect()
    finally:
        counts.unpersist()
    found = {r["pos"]: 2.0 * r["weighted"] / (r["n"] * r["total"]) - (r["n"] + 1) / r["n"] if r["total"] else 0.0 for r in sums}
    return small_table(spark, [(k.name, found.get(k.position, 0.0)) for k in kinds], "name string, gini double")


def francia_sums(mean: Column, n: Column) -> list[Column]:
    """Aggregates over the ranked table for the squared correlation of values with the normal scores of their ranks."""
    c, score = F.col("cnt").cast("double"), F.col("score")
    return [F.sum(c * score).alias("score_sum"), F.sum(c * score * score).alias("score_square"), F.sum(c * score * (F.col("value") - mean)).alias("score_cross")]


def francia_statistic(n: int, scores: float, squares: float, cross: float, m2: float) -> float | None:
    spread = (squares - scores * scores / n) * m2
    return min(cross * cross / spread, 1.0) if spread > 0 else None


def histogram_plan(n: int, lo: float, hi: float, iqr: float, integers: bool) -> int:
    """Number of bins: Freedman-Diaconis if 1 to 40, else a square-root rule."""
    if n < 2:
        return 0
    width = 2.0 * iqr * n ** (-1.0 / 3.0)
    if integers and 0 < width < 1.0:
        width = 1.0
    span = hi - lo if hi > lo else 1.0
    suggested = int(np.ceil(span / width)) if width > 0 else 1
    return suggested if 1 <= suggested <= MAX_BINS else min(MAX_BINS, max(MIN_BINS, int(n**0.5)))


def bin_of(value: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """0-based equal-width bin, last bin closed, settled against the exact edges."""
    step = (hi - lo) / bins
    guess = F.least(F.floor((value - lo) * (bins / (hi - lo))), bins - 1)
    down = value < lo + guess * step
    up = (value >= lo + (guess + 1) * step) & (guess != bins - 1)
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess).cast("int")


def spread_cells(counts: DataFrame, facts: dict[int, dict]) -> DataFrame:
    """``(pos, bin, held, tukey, robust)``: histogram bins and outlier counts in one pass.

    ``facts``: per column the bin range and number, quartiles, median and MAD.
    """
    fact = lambda name: per_column({p: m[name] for p, m in facts.items()})
    value, p25, p75, bins = F.col("value"), fact("p25"), fact("p75"), fact("bins")
    fence = F.lit(FENCE) * (p75 - p25)
    beyond = (p75 > p25) & ((value < p25 - fence) | (value > p75 + fence))
    far = F.abs(robust_score(fact("median"), fact("mad"))) > ROBUST_CUT
    bin_index = F.when(bins > 0, bin_of(value, fact("lo"), fact("hi"), bins))
    return counts.groupBy("pos", bin_index.alias("bin")).agg(
        F.sum("cnt").alias("held"),
        F.sum(F.when(beyond, F.col("cnt")).otherwise(0)).alias("tukey"),
        F.sum(F.when(far, F.col("cnt")).otherwise(0)).alias("robust"),
    )


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    step = (hi - lo) / bins
    return [lo + i * step for i in range(bins)] + [hi]


def robust_score(median: Column, mad: Column) -> Column:
    return F.when(mad > 0, F.lit(ROBUST_FACTOR) * (F.col("value") - median) / mad)


def outlier_table(counts: DataFrame, centres: DataFrame, limit: int = TOP_OUTLIERS) -> DataFrame:
    """Up to ``limit`` most extreme robust outliers of each column, repeats included.

    ``centres``: one ``(pos, name, median, mad)`` row per column.
    """
    z = robust_score(F.col("median"), F.col("mad"))
    order = Window.partitionBy("pos").orderBy(F.abs("z").desc(), "value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    flagged = counts.join(F.broadcast(centres), "pos").withColumn("z", z).where(F.abs("z") > ROBUST_CUT)
    # limit distinct values first: Spark then keeps only `limit` rows per task before the shuffle
    top = flagged.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    first = F.sum("cnt").over(upto) - F.col("cnt") + 1
    return (
        top.withColumn("first", first).where(F.col("first") <= limit)
        .select(
            "name", "value", "z",
            F.explode(F.sequence("first", F.least(F.col("first") + F.col("cnt") - 1, F.lit(limit)))).alias("rank"),
        )
        .select("name", "rank", "value", "z")
    )


@dataclass
class NumericProfile:
    summary: DataFrame
    histogram: DataFrame
    outliers: DataFrame
    unusable: list[tuple]


HISTOGRAM_SCHEMA = "name string, bin int, bin_lo double, bin_hi double, cnt bigint"
OUTLIER_SCHEMA = "name string, rank bigint, value double, z double"


def profile_numeric(
    df: DataFrame,
    kinds: list[ColumnKind],
    mad_scale: float = MAD_SCALE,
) -> NumericProfile:
    """The full numeric panel for every column in ``kinds``."""
    spark = df.sparkSession
    everything = ranking.hold(numeric_counts(df, kinds))
    try:
        by_pos = {r["pos"]: r.asDict() for r in numeric_facts(everything).collect()}
        unusable, usable = [], {}
        for k in kinds:
            m = by_pos.get(k.position) or {"total_rows": 0, "missing": 0, "count": 0}
            m["missing_pct"] = m["missing"] / m["total_rows"] if m["total_rows"] else 0.0
            m.update(name=k.name, position=k.position)
            if m["count"]:
                usable[k.position] = m
            else:
                unusable.append((k.name, k.position, m["total_rows"], m["missing"], m["missing_pct"], NO_NUMBERS))
        bins, spots = [], []
        if usable:
            counts = everything.where(F.col("value").isNotNull())
            _fill_moments(counts, usable)
            _fill_ranks(counts, usable)
            _fill_mad(counts, usable, mad_scale)
            bins, spots = _fill_spread(counts, usable)
    finally:
        everything.unpersist()
    rows = [tuple(m.get(f.name) for f in NUMERIC_SCHEMA.fields) for m in usable.values()]
    return NumericProfile(
        small_table(spark, rows, NUMERIC_SCHEMA),
        small_table(spark, bins, HISTOGRAM_SCHEMA),
        small_table(spark, spots, OUTLIER_SCHEMA),
        unusable,
    )


def _quartile_facts(counts: DataFrame, kinds: list[ColumnKind]) -> dict[int, dict]:
    """Facts, quartiles and median of usable columns by selection, without ranking."""
    facts = {r["pos"]: r.asDict() for r in numeric_facts(counts).collect() if r["count"]}
    known = {p: ranking.Extent(m["count"], m["distinct"], m["min"], m["max"]) for p, m in facts.items()}
    points = {"p25": 0.25, "p75": 0.75, "median": 0.5}
    ranks = {p: {r for q in points.values() for r in ranking.quantile_ranks(m["count"], q)} for p, m in facts.items()}
    at = ranking.order_statistics(counts.where(F.col("value").isNotNull()), ranks, known)
    for k in kinds:
        if k.position in facts:
            m = facts[k.position]
            m["name"] = k.name
            for name, q in points.items():
                m[name] = ranking.quantile_from(at, k.position, m["count"], q)
            m["iqr"] = m["p75"] - m["p25"]
    return facts


def histograms(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Only the histograms: ``(name, bin, bin_lo, bin_hi, cnt)``, empty bins kept."""
    return _spread_only(df, kinds)[0]


def robust_outliers(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Only the most extreme robust outliers: ``(name, rank, value, z)``."""
    return _spread_only(df, kinds)[1]


def _spread_only(df: DataFrame, kinds: list[ColumnKind]) -> tuple[DataFrame, DataFrame]:
    everything = ranking.hold(numeric_counts(df, kinds))
    try:
        facts = _quartile_facts(everything, kinds)
        counts = everything.where(F.col("value").isNotNull())
        bins, spots = [], []
        if facts:
            _fill_mad(counts, facts, MAD_SCALE)
            bins, spots = _fill_spread(counts, facts)
    finally:
        everything.unpersist()
    spark = df.sparkSession
    return small_table(spark, bins, HISTOGRAM_SCHEMA), small_table(spark, spots, OUTLIER_SCHEMA)


def _fill_moments(counts: DataFrame, usable: dict[int, dict]) -> None:
    for r in central_moments(counts, {p: m["mean"] for p, m in usable.items()}).collect():
        m = usable[r["pos"]]
        m.update(shape_statistics(m["count"], r["m2"], r["m3"], r["m4"]), m2=r["m2"])
        m["cv"] = m["std"] / abs(m["mean"]) if m["mean"] else None
        m["format_hint"] = "year" if looks_like_years(m["name"], m["whole"], m["min"], m["max"]) else "standard"


def _fill_ranks(counts: DataFrame, usable: dict[int, dict]) -> None:
    """Percentiles, Gini and the normality test in one ranking.

    Gini ranks |x|; a column of mixed signs takes part a second time, folded.
    """
    sizes = {p: (m["count"], m["distinct"]) for p, m in usable.items()}
    mixed = [p for p, m in usable.items() if m["min"] < 0]
    offset = max(usable) + 1
    table = counts.select("pos", "value", "cnt")
    if mixed:
        folded = counts.where(F.col("pos").isin(*mixed)).select(
            (F.col("pos") + offset).alias("pos"), F.abs("value").alias("value"), "cnt"
        )
        table = table.unionByName(ranking.count_values(folded, F.col("cnt")))
    every = sizes | {p + offset: sizes[p] for p in mixed}
    ranked = ranking.with_sizes(ranking.with_rows_before(table, every), every)
    extra = [gini_sum().alias("weighted"), F.sum(F.col("value") * F.col("cnt")).alias("total")]
    ranked = ranked.withColumn("score", normal_score(ranking.average_rank(), F.col("n")))
    extra += francia_sums(per_column({p: m["mean"] for p, m in usable.items()}), F.col("n"))
    at = {r["pos"]: r for r in ranking.exact_quantiles(ranked, PERCENTILES, extra).collect()}
    for p, m in usable.items():
        m.update({name: at[p][name] for name in PERCENTILES}, median=at[p]["p50"])
        m["iqr"] = m["p75"] - m["p25"]
        sums = at[p + offset] if p in mixed else at[p]
        n, total = m["count"], sums["total"]
        m["gini"] = 2.0 * sums["weighted"] / (n * total) - (n + 1) / n if total else 0.0
        if n >= MIN_NORMALITY_ROWS and m["distinct"] >= MIN_NORMALITY_VALUES:
            w = francia_statistic(n, at[p]["score_sum"], at[p]["score_square"], at[p]["score_cross"], m["m2"])
            if w is not None:
                m.update(normality_statistic=w, normality_p=francia_p(w, n), normality_test="shapiro_francia")


def _fill_mad(counts: DataFrame, usable: dict[int, dict], scale: float) -> None:
    middle = per_column({p: m["median"] for p, m in usable.items()})
    distance = counts.select("pos", F.abs(F.col("value") - middle).alias("value"), "cnt")
    known = {
        p: ranking.Extent(m["count"], m["distinct"], 0.0, max(m["max"] - m["median"], m["median"] - m["min"]))
        for p, m in usable.items()
    }
    for p, value in ranking.medians(distance, known).items():
        usable[p]["mad"] = value * scale if usable[p]["count"] > 1 else 0.0


def _fill_spread(counts: DataFrame, usable: dict[int, dict]) -> tuple[list[tuple], list[tuple]]:
    """Histogram rows and outlier rows; at most 40 and 50 per column."""
    for m in usable.values():
        integers = m["whole"] and m["count"] == m["total_rows"]
        m["lo"], m["hi"] = (m["min"], m["max"]) if m["max"] > m["min"] else (m["min"] - 0.5, m["max"] + 0.5)
        m["bins"] = histogram_plan(m["count"], m["min"], m["max"], m["iqr"], integers)
        m.update(outlier_iqr_count=0, outlier_robust_count=0)
    held: dict[tuple[int, int], int] = {}
    for r in spread_cells(counts, usable).collect():
        m = usable[r["pos"]]
        m["outlier_iqr_count"] += r["tukey"]
        m["outlier_robust_count"] += r["robust"]
        held[(r["pos"], r["bin"])] = r["held"]
    bins, spots = [], []
    for p, m in usable.items():
        edges = bin_edges(m["lo"], m["hi"], m["bins"]) if m["bins"] else []
        bins += [(m["name"], i, edges[i], edges[i + 1], held.get((p, i), 0)) for i in range(m["bins"])]
    if any(m["outlier_robust_count"] for m in usable.values()):
        centres = [(p, m["name"], m["median"], m["mad"]) for p, m in usable.items()]
        where = small_table(counts.sparkSession, centres, "pos int, name string, median double, mad double")
        spots = [tuple(r) for r in outlier_table(counts, where).collect()]
    return bins, spots


# ----- categorical -----------------------------------------------------------


def category_counts(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Distinct trimmed values of every categorical column with counts."""
    text = {k.position: F.trim(name_column(k.name).cast("string")) for k in kinds}
    return ranking.count_values(ranking.long_form(df, text).where(F.col("value") != ""))


def top_values_table(counts: DataFrame, kinds: list[ColumnKind], limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column; ties by value."""
    spark = counts.sparkSession
    names = small_table(spark, [(k.position, k.name) for k in kinds], "pos int, name string")
    order = Window.partitionBy("pos").orderBy(F.col("cnt").desc(), "value")
    totals = counts.groupBy("pos").agg(F.sum("cnt").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return (
        top.join(F.broadcast(totals), "pos").join(F.broadcast(names), "pos")
        .select("name", "rank", "value", F.col("cnt"), (F.col("cnt") / F.col("n")).alias("pct"))
    )


def categorical_summary(df: DataFrame, counts: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Counts, mode and normalised entropy per categorical column."""
    spark = df.sparkSession
    names = small_table(spark, [(k.position, k.name) for k in kinds], "pos int, name string")
    blanks = df.agg(F.count(F.lit(1)).alias("total_rows"), F.array(*[
        F.struct(F.lit(k.position).alias("pos"), F.count_if(blank_cell(df, k)).alias("missing")) for k in kinds
    ]).alias("per")).select("total_rows", F.inline("per"))
    c = F.col("cnt").cast("double")
    shape = counts.groupBy("pos").agg(
        F.sum("cnt").alias("count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.max("cnt").alias("mode_frequency"),
        F.sum(c * F.log2(c)).alias("c_log_c"),
    )
    # smallest of the most frequent values
    leading = F.col("cnt") == F.col("mode_frequency")
    close = (F.col("mode_frequency") - F.col("cnt")) / F.col("count") < TIE
    mode = counts.join(F.broadcast(shape.select("pos", "mode_frequency", F.col("count").cast("double").alias("count"))), "pos").where(close).groupBy("pos").agg(
        F.min(F.when(leading, F.col("value"))).alias("mode"), F.count(F.lit(1)).alias("tied_count")
    )
    n, k = F.col("count").cast("double"), F.col("unique_count").cast("double")
    # -sum(p log p) = log n - sum(c log c)/n
    entropy = F.when(k <= 1, 0.0).otherwise(F.try_divide(F.log2(n) - F.col("c_log_c") / n, F.log2(k)))
    return (
        names.join(blanks, "pos").join(shape, "pos", "left").join(mode, "pos", "left")
        .select(
            "name", F.col("pos").alias("position"), "total_rows", "missing",
            F.coalesce(guarded_ratio(F.col("missing"), F.col("total_rows")), F.lit(0.0)).alias("missing_pct"),
            F.coalesce("count", F.lit(0)).alias("count"), "unique_count", "mode", "mode_frequency",
            entropy.alias("entropy_normalized"), "tied_count",
        )
    )


# ----- datetime --------------------------------------------------------------


def gap_table(
    instants: DataFrame, sizes: dict[int, tuple[int, int]], bucket_values: int = ranking.BUCKET_VALUES
) -> DataFrame:
    """Gaps between consecutive instants as a count table ``(pos, value, cnt)`` in microseconds.

    ``instants`` is a held count table of epoch microseconds. Repeated instants
    are gaps of zero. Distinct instants are cut into ranges of about equal
    number, so no task sorts a whole series; the gap across a range border is
    taken from the last instant of the range before.
    """
    placed = ranking.with_buckets(instants, sizes, bucket_values)
    inside = placed.withColumn(
        "gap", F.col("value") - F.lag("value").over(Window.partitionBy("pos", "bucket").orderBy("value"))
    )
    once, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # a gap to the instant before, and one gap of zero per repetition
    stacked = inside.select("pos", F.inline(F.array(
        F.struct(F.col("gap").alias("value"), once.alias("cnt")), F.struct(none.alias("value"), (F.col("cnt") - 1).alias("cnt"))
    ))).where(F.col("cnt") > 0)
    if max((d for _, d in sizes.values()), default=0) > bucket_values:
        edges = placed.groupBy("pos", "bucket").agg(F.min("value").alias("head"), F.max("value").alias("tail"))
        before = F.lag("tail").over(Window.partitionBy("pos").orderBy("bucket"))
        stacked = stacked.unionByName(edges.select("pos", (F.col("head") - before).alias("value"), once.alias("cnt")))
    return ranking.count_values(stacked, F.col("cnt"))


def cadence(gap_days: Column, guard_zero: bool = False) -> Column:
    """Cadence label of a median gap; ``guard_zero`` calls gaps <= 0 irregular."""
    out = F.when(gap_days.isNull(), "irregular")
    if guard_zero:
        out = out.when(gap_days <= 0, "irregular")
    for limit, label, _ in CADENCES:
        out = out.when(gap_days <= limit, label)
    return out.otherwise("irregular")


def median_gap_days(gaps: DataFrame) -> dict[int, float]:
    """Median gap in days per column of a held gap table."""
    return {p: gap / MICROS_PER_DAY for p, gap in ranking.medians(gaps).items()}


def granularity(gap_days: float | None) -> tuple[str, float | None]:
    """Cadence name and expected gap of a median gap."""
    for limit, label, days in CADENCES:
        if gap_days is not None and gap_days <= limit:
            return label, days
    return "irregular", None


def profile_datetime(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Range, cadence and gap count of every datetime column."""
    long = ranking.long_form(
        df, {k.position: cells.epoch_micros(typed_cell(df, k)) for k in kinds},
        {k.position: {"blank": blank_cell(df, k)} for k in kinds},
    )
    # one row (pos, NULL, cnt, blanks) per column holds its unusable cells
    everything = ranking.hold(long.groupBy("pos", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if("blank").alias("blanks")
    ))
    instants = everything.where(F.col("value").isNotNull())
    gaps = None
    try:
        usable = F.when(F.col("value").isNotNull(), F.col("cnt"))
        facts = {r["pos"]: r for r in everything.groupBy("pos").agg(
            F.sum("cnt").alias("total_rows"), F.sum("blanks").alias("missing"), F.sum(usable).alias("n"),
            F.count("value").alias("distinct"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        ).collect()}
        sizes = {p: (f["n"], f["distinct"]) for p, f in facts.items() if f["n"]}
        gaps = ranking.hold(gap_table(instants, sizes))
        middle = median_gap_days(gaps)
        expected = {p: granularity(gap)[1] for p, gap in middle.items()}
        late = {}
        if any(expected.values()):
            days = F.col("value") / F.lit(MICROS_PER_DAY)
            over = F.when(days > F.lit(GAP_SLACK) * per_column(expected), F.col("cnt")).otherwise(0)
            late = {r["pos"]: r["late"] for r in gaps.groupBy("pos").agg(F.sum(over).alias("late")).collect()}
    finally:
        if gaps is not None:
            gaps.unpersist()
        everything.unpersist()
    rows = []
    for k in kinds:
        f = facts.get(k.position)
        total, missing = (f["total_rows"], f["missing"]) if f else (0, 0)
        n, lo, hi = (f["n"] or 0, f["lo"], f["hi"]) if f else (0, None, None)
        rows.append((k.name, k.position, total, missing, missing / total if total else 0.0, n, lo, hi,
                     int((hi - lo) // MICROS_PER_DAY) if n else None, granularity(middle.get(k.position))[0],
                     late.get(k.position, 0)))
    table = small_table(
        df.sparkSession, rows, "name string, position int, total_rows bigint, missing bigint, missing_pct double, "
        "count bigint, min_date bigint, max_date bigint, range_days bigint, granularity string, gap_count bigint"
    )
    return table.withColumn("min_date", cells.from_epoch_micros(F.col("min_date"))).withColumn(
        "max_date", cells.from_epoch_micros(F.col("max_date"))
    )


# ----- boolean, unknown ------------------------------------------------------


def boolean_summary(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """True and false counts of every boolean column; one scan."""
    spark = df.sparkSession
    names = small_table(spark, [(k.position, k.name) for k in kinds], "pos int, name string")
    per = df.agg(F.count(F.lit(1)).alias("total_rows"), F.array(*[
        F.struct(
            F.lit(k.position).alias("pos"),
            F.count_if(blank_cell(df, k)).alias("missing"),
            F.count_if(typed_cell(df, k)).alias("true_count"),
            F.count_if(~typed_cell(df, k)).alias("false_count"),
        ) for k in kinds
    ]).alias("per")).select("total_rows", F.inline("per"))
    n = F.col("true_count") + F.col("false_count")
    return names.join(per, "pos").select(
        "name", F.col("pos").alias("position"), "total_rows", "missing",
        F.coalesce(guarded_ratio(F.col("missing"), F.col("total_rows")), F.lit(0.0)).alias("missing_pct"),
        n.alias("count"), "true_count", "false_count",
        guarded_ratio(F.col("true_count"), n).alias("true_pct"),
    )


def profile(df: DataFrame, kinds: list[ColumnKind] | None = None) -> Profile:
    """Profile every column of a table by its kind."""
    spark = df.sparkSession
    kinds = kinds or kinds_from_schema(df)
    base = ["name", "position", "total_rows", "missing", "missing_pct"]
    unknown: list[tuple] = []

    numeric = profile_numeric(df, of_kind(kinds, "numeric")) if of_kind(kinds, "numeric") else None
    if numeric is None:
        numeric = NumericProfile(
            small_table(spark, [], NUMERIC_SCHEMA),
            small_table(spark, [], HISTOGRAM_SCHEMA), small_table(spark, [], OUTLIER_SCHEMA), [],
        )
    unknown += numeric.unusable

    def usable(table: DataFrame, reason: str) -> DataFrame:
        """Split off columns without a usable value; tables have one row per column."""
        rows = table.collect()
        unknown.extend((*[r[c] for c in base], reason) for r in rows if r["count"] == 0)
        return small_table(spark, [r for r in rows if r["count"]], table.schema)

    text = of_kind(kinds, "categorical")
    if text:
        counts = ranking.hold(category_counts(df, text))
        categorical = usable(categorical_summary(df, counts, text), NO_CATEGORIES)
        top_rows = top_values_table(counts, text)
        top = small_table(spark, top_rows.collect(), top_rows.schema)  # five rows per column
        counts.unpersist()
    else:
        categorical = small_table(spark, [], "name string, position int, total_rows bigint, missing bigint, "
                                            "missing_pct double, count bigint, unique_count bigint, mode string, "
                                            "mode_frequency bigint, entropy_normalized double, tied_count bigint")
        top = small_table(spark, [], "name string, rank int, value string, cnt bigint, pct double")
    dates = of_kind(kinds, "datetime")
    datetime = usable(profile_datetime(df, dates), NO_DATES) if dates else small_table(spark, 
        [], "name string, position int, total_rows bigint, missing bigint, missing_pct double, count bigint, "
        "min_date timestamp_ntz, max_date timestamp_ntz, range_days bigint, granularity string, gap_count bigint")
    flags = of_kind(kinds, "boolean")
    boolean = usable(boolean_summary(df, flags), NO_BOOLEANS) if flags else small_table(spark, 
        [], "name string, position int, total_rows bigint, missing bigint, missing_pct double, count bigint, "
        "true_count bigint, false_count bigint, true_pct double")

    other = [k for k in kinds if k.kind not in KINDS[:-1]]
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"),
                    *[F.count_if(blank_cell(df, k)).alias(f"m{k.position}") for k in other]).first()
    rows = totals["total_rows"]
    for k in other:
        missing = totals[f"m{k.position}"]
        unknown.append((k.name, k.position, rows, missing, missing / rows if rows else 0.0, UNSUPPORTED.format(k.kind)))
    return Profile(
        rows, len(kinds), numeric.summary, numeric.histogram, numeric.outliers, categorical, top,
        datetime, boolean, small_table(spark, sorted(unknown, key=lambda r: r[1]), UNKNOWN_SCHEMA),
    )


def missing_report(profiled: Profile) -> DataFrame:
    """Columns with missing values, worst first (ties in source order)."""
    cols = ["name", "position", "total_rows", "missing", "missing_pct"]
    parts = [profiled.numeric, profiled.categorical, profiled.datetime, profiled.boolean, profiled.unknown]
    stacked = parts[0].select(*cols)
    for p in parts[1:]:
        stacked = stacked.unionByName(p.select(*cols))
    return stacked.where(F.col("missing") > 0).orderBy(F.col("missing_pct").desc(), "position")


def columns_by_kind(profiled: Profile) -> DataFrame:
    """Column names grouped by kind in the fixed order, source order inside."""
    named = {"numeric": profiled.numeric, "categorical": profiled.categorical, "datetime": profiled.datetime,
             "boolean": profiled.boolean, "unknown": profiled.unknown}
    stacked = None
    for rank, kind in enumerate(KINDS):
        part = named[kind].select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), "position", "name")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.orderBy("kind_rank", "position")
