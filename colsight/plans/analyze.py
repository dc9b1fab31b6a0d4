"""The whole analysis of one table: profile, relate, segment, trace, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from colsight.operators import findings as rules
from colsight.operators.kinds import ColumnKind, apply_kinds, infer_kinds, kinds_from_schema, normalize_missing, of_kind, with_layouts
from colsight.operators.profile import Profile, profile
from colsight.operators.ranking import hold
from colsight.operators.relate import Relations, relate
from colsight.operators.segment import Segments, segment
from colsight.operators.trend import Trends, trace
from colsight.sources.report import combine


@dataclass
class Analysis:
    kinds: list[ColumnKind]
    profile: Profile
    relations: Relations
    segments: Segments
    trends: Trends
    findings: DataFrame
    report: DataFrame
    parts: dict[str, tuple[DataFrame, list[str]]]

    def tables(self) -> dict[str, tuple[DataFrame, list[str]]]:
        """Every result as a table with the columns it is partitioned by on disk: the bounded ones of the report, and those
        that grow with the rows."""
        out = {name: (table, []) for name, (table, _) in self.parts.items() if name != "projection"}
        out["projection_cells"] = (self.segments.cells, [])
        out["projection"] = (self.segments.projection, ["cluster"])
        out["history"] = (self.trends.history, [])
        out["anchors"] = (self.trends.anchors, [])
        return out


def all_findings(profiled: Profile, relations: Relations, segments: Segments, trends: Trends) -> DataFrame:
    """Every finding of one analysis, stacked."""
    parts = [
        rules.numeric_findings(profiled.numeric),
        rules.categorical_findings(profiled.categorical, profiled.top_values),
        rules.datetime_findings(profiled.datetime),
        rules.boolean_findings(profiled.boolean),
        rules.unknown_findings(profiled.unknown),
        rules.pair_findings(relations.top),
        rules.linear_findings(relations.models, relations.coefficients),
        rules.logistic_findings(relations.models, relations.coefficients),
        rules.segment_findings(segments.summary),
        rules.cluster_findings(segments.clusters, segments.features),
        rules.trend_findings(trends.trends, trends.forecast),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prepare(df: DataFrame, kinds: list[ColumnKind] | None = None, order_by: list[str] | None = None):
    """Normalised table and kinds: inferred when every column is text, else from the schema."""
    clean = normalize_missing(df)
    if kinds is None:
        all_text = all(t == "string" for _, t in df.dtypes)
        kinds = infer_kinds(clean, order_by) if all_text else kinds_from_schema(df)
    return clean, with_layouts(clean, kinds)


def analyze(df: DataFrame, kinds: list[ColumnKind] | None = None, order_by: list[str] | None = None) -> Analysis:
    """Run every analysis over one table and combine the results.

    The typed numeric, boolean and datetime columns are held once and shared; the
    profile reads the normalised table, because blanks and unreadable cells differ.
    """
    clean, kinds = prepare(df, kinds, order_by)
    profiled = profile(clean, kinds)
    shared = of_kind(kinds, "numeric", "boolean", "datetime")
    typed = hold(apply_kinds(clean, shared))
    try:
        relations = relate(typed, shared)
        segments = segment(typed, shared)
        trends = trace(typed, shared)
    finally:
        typed.unpersist()
    found = all_findings(profiled, relations, segments, trends)
    parts = {
        "numeric": (profiled.numeric, ["position"]),
        "histogram": (profiled.histogram, ["name", "bin"]),
        "outliers": (profiled.outliers, ["name", "rank"]),
        "categorical": (profiled.categorical, ["position"]),
        "top_values": (profiled.top_values, ["name", "rank"]),
        "datetime": (profiled.datetime, ["position"]),
        "boolean": (profiled.boolean, ["position"]),
        "unknown": (profiled.unknown, ["position"]),
        "pearson": (relations.pearson, ["i", "j"]),
        "spearman": (relations.spearman, ["i", "j"]),
        "top_pairs": (relations.top, ["bucket", "rank"]),
        "models": (relations.models, ["kind", "target"]),
        "coefficients": (relations.coefficients, ["kind", "target", "rank"]),
        "segments": (segments.summary, ["k"]),
        "k_candidates": (segments.candidates, ["k"]),
        "clusters": (segments.clusters, ["cluster"]),
        "cluster_features": (segments.features, ["cluster", "rank"]),
        "projection": (segments.cells, ["cluster", "cell_x", "cell_y"]),
        "trends": (trends.trends, ["datetime_column", "value_column"]),
        "forecast": (trends.forecast, ["datetime_column", "value_column", "step"]),
        "findings": (found, ["section", "subject", "position"]),
    }
    report = combine(
        df.sparkSession, parts,
        row_count=("bigint", profiled.row_count), column_count=("int", profiled.column_count),
        series_skipped_reason=("string", trends.skipped_reason),
    )
    return Analysis(kinds, profiled, relations, segments, trends, found, report, parts)
