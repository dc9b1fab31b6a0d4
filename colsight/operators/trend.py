"""Linear trends and forecasts of (datetime, numeric) pairs.

All pairs share one scan per step: rows are unpivoted to ``(pos, value, at)`` and
grouped by pair. Gaps between instants come from ranges of instants, so a series
of any length is never sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.functions import cells
from colsight.functions.tables import per_column, small_table
from colsight.operators import ranking
from colsight.operators.kinds import ColumnKind, of_kind, typed_cell
from colsight.operators.profile import MICROS_PER_DAY, cadence, gap_table, median_gap_days

# --- fixed values: limits and reasons ----------------------------------------
MIN_POINTS = 10
MAX_FORECAST = 12
FORECAST_SHARE = 0.25
UNIQUE_SHARE = 0.95
Z_95 = 1.96
NO_DATES = "No datetime column detected; need one to track values over time."
NO_VALUES = "No numeric columns to track over time."
NO_SERIES = "No analyzable time-series found in this dataset."
# --- end of fixed values -----------------------------------------------------

TREND_SCHEMA = (
    "datetime_column string, value_column string, n_observations bigint, first_at timestamp_ntz, "
    "last_at timestamp_ntz, last_day double, mean_value double, trend_slope double, trend_intercept double, "
    "trend_r_squared double, residual_std double, median_gap_days double, cadence_label string"
)
GATE_SCHEMA = "datetime_column string, n bigint, distinct_times bigint, eligible boolean, reason string"


@dataclass
class Trends:
    trends: DataFrame
    forecast: DataFrame
    history: DataFrame
    anchors: DataFrame
    skipped_reason: str | None


def series_gate(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Which datetime columns may carry a series, and why not."""
    dates = of_kind(kinds, "datetime")
    names = small_table(df.sparkSession, [(k.position, k.name) for k in dates], "pos int, datetime_column string")
    micros = {k.position: cells.epoch_micros(typed_cell(df, k)) for k in dates}
    counts = ranking.count_values(ranking.long_form(df, micros))
    sizes = counts.groupBy("pos").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("d"))
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    reason = (
        F.when(n == 0, "no dates").when(d < MIN_POINTS, "too few distinct times")
        .when(d < n * F.lit(UNIQUE_SHARE), "repeated times")
    )
    return names.join(sizes, "pos", "left").select(
        "datetime_column", n.alias("n"), d.alias("distinct_times"), reason.isNull().alias("eligible"),
        reason.alias("reason"),
    )


def _pairs(dates: list[ColumnKind], values: list[ColumnKind]) -> dict[int, tuple[ColumnKind, ColumnKind]]:
    return dict(enumerate((d, v) for d in dates for v in values))


def series_rows(df: DataFrame, pairs: dict[int, tuple[ColumnKind, ColumnKind]]) -> DataFrame:
    """``(pos, value, at)`` of rows complete in both columns; ``at`` in microseconds."""
    values = {p: typed_cell(df, v) for p, (_, v) in pairs.items()}
    at = {p: {"at": cells.epoch_micros(typed_cell(df, d))} for p, (d, _) in pairs.items()}
    return ranking.long_form(df, values, at).where(F.col("value").isNotNull() & F.col("at").isNotNull())


def fit_trends(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """One row per analysable pair: slope per day, intercept, fit, spread and cadence."""
    spark = df.sparkSession
    gate = {r["datetime_column"]: r for r in series_gate(df, kinds).collect()} if of_kind(kinds, "datetime") else {}
    dates = [d for d in of_kind(kinds, "datetime") if gate[d.name]["eligible"]]
    pairs = _pairs(dates, of_kind(kinds, "numeric"))
    if not pairs:
        return small_table(spark, [], TREND_SCHEMA)
    ends = {
        r["pos"]: r for r in series_rows(df, pairs).groupBy("pos").agg(
            F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"),
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"),
        ).collect()
    }
    pairs = {p: pair for p, pair in pairs.items()
             if p in ends and ends[p]["n"] >= MIN_POINTS and ends[p]["lo"] < ends[p]["hi"]}
    if not pairs:
        return small_table(spark, [], TREND_SCHEMA)

    x = (F.col("at") - per_column({p: ends[p]["first"] for p in pairs}, "bigint")) / F.lit(MICROS_PER_DAY)
    y = F.col("value") - per_column({p: ends[p]["mean"] for p in pairs})  # the intercept is moved back below
    fits = {
        r["pos"]: r for r in series_rows(df, pairs).groupBy("pos").agg(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
            F.regr_sxx(y, x).alias("sxx"),
        ).collect()
    }
    gaps = _median_gaps(df, pairs, {p: ends[p]["n"] == gate[d.name]["n"] for p, (d, _) in pairs.items()})
    rows = []
    for p, (d, v) in pairs.items():
        e, f = ends[p], fits[p]
        rest = f["syy"] - f["sxy"] ** 2 / f["sxx"]
        rows.append((p, d.name, v.name, e["n"], e["first"], e["last"], e["mean"], f["slope"],
                     f["intercept"] + e["mean"], f["r2"], (max(rest, 0.0) / max(e["n"] - 2, 1)) ** 0.5, gaps.get(p)))
    raw = small_table(
        spark, rows, "pos int, datetime_column string, value_column string, n_observations bigint, first bigint, "
        "last bigint, mean_value double, trend_slope double, trend_intercept double, trend_r_squared double, "
        "residual_std double, gap double"
    )
    return raw.select(
        "datetime_column", "value_column", "n_observations",
        cells.from_epoch_micros(F.col("first")).alias("first_at"), cells.from_epoch_micros(F.col("last")).alias("last_at"),
        ((F.col("last") - F.col("first")) / F.lit(MICROS_PER_DAY)).alias("last_day"),
        "mean_value", "trend_slope", "trend_intercept", "trend_r_squared", "residual_std",
        F.when(F.col("gap") > 0, F.col("gap")).otherwise(1.0).alias("median_gap_days"),
        cadence(F.col("gap"), guard_zero=True).alias("cadence_label"),
    )


def _median_gaps(df: DataFrame, pairs: dict, whole: dict[int, bool]) -> dict[int, float]:
    """Median gap in days per pair; pairs that lose no row share their date column's."""
    series, owner = {}, {}
    for p, (d, v) in pairs.items():
        at = cells.epoch_micros(typed_cell(df, d))
        key = d.name if whole[p] else (d.name, v.name)
        if key not in series:
            series[key] = (len(series), at if whole[p] else F.when(typed_cell(df, v).isNotNull(), at))
        owner[p] = series[key][0]
    instants = ranking.hold(ranking.count_values(ranking.long_form(df, dict(series.values()))))
    gaps = ranking.hold(gap_table(instants, ranking.column_sizes(instants)))
    try:
        found = median_gap_days(gaps)
    finally:
        gaps.unpersist()
        instants.unpersist()
    return {p: found.get(o) for p, o in owner.items()}


def forecast(trends: DataFrame) -> DataFrame:
    """Values one median gap apart after the last point, with a constant 95 % band."""
    horizon = F.least(F.lit(MAX_FORECAST), F.greatest(F.lit(1), F.floor(F.col("n_observations") * F.lit(FORECAST_SHARE))))
    half = F.lit(Z_95) * F.col("residual_std")
    step = trends.select("*", F.explode(F.sequence(F.lit(1), horizon.cast("int"))).alias("step"))
    ahead = F.col("median_gap_days") * F.col("step")
    value = F.col("trend_slope") * (F.col("last_day") + ahead) + F.col("trend_intercept")
    at = cells.epoch_micros(F.col("last_at")) + F.round(ahead * F.lit(MICROS_PER_DAY)).cast("bigint")
    return step.select(
        "datetime_column", "value_column", "step", cells.from_epoch_micros(at).alias("at"), value.alias("value"),
        (value - half).alias("lower_95"), (value + half).alias("upper_95"),
    )


def history(df: DataFrame, kinds: list[ColumnKind], trends: DataFrame) -> DataFrame:
    """Observed points of every analysed pair in time order (ties by value)."""
    by_name = {k.name: k for k in kinds}
    keys = [(r["datetime_column"], r["value_column"]) for r in trends.select("datetime_column", "value_column").collect()]
    pairs = {i: (by_name[d], by_name[v]) for i, (d, v) in enumerate(keys)}
    if not pairs:
        return small_table(df.sparkSession, [], "datetime_column string, value_column string, at timestamp_ntz, value double")
    names = small_table(df.sparkSession, [(i, d, v) for i, (d, v) in enumerate(keys)],
                        "pos int, datetime_column string, value_column string")
    return (
        series_rows(df, pairs).join(F.broadcast(names), "pos")
        .orderBy("datetime_column", "value_column", "at", "value")
        .select("datetime_column", "value_column", cells.from_epoch_micros(F.col("at")).alias("at"), "value")
    )


def trend_anchors(trends: DataFrame) -> DataFrame:
    """The two ends of each trend line."""
    ends = F.array(
        F.struct(F.lit("first").alias("end"), F.col("first_at").alias("at"), F.col("trend_intercept").alias("value")),
        F.struct(F.lit("last").alias("end"), F.col("last_at").alias("at"),
                 (F.col("trend_intercept") + F.col("trend_slope") * F.col("last_day")).alias("value")),
    )
    return trends.select("datetime_column", "value_column", F.inline(ends))


def trace(df: DataFrame, kinds: list[ColumnKind]) -> Trends:
    """Trends, forecasts, history and anchors of every analysable pair."""
    trends = fit_trends(df, kinds)
    if not of_kind(kinds, "datetime"):
        reason = NO_DATES
    elif not of_kind(kinds, "numeric"):
        reason = NO_VALUES
    else:
        reason = None if not trends.isEmpty() else NO_SERIES
    return Trends(trends, forecast(trends), history(df, kinds, trends), trend_anchors(trends), reason)
