"""Column kinds: inference from text, from a schema, and typed projection."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions import cells
from colsight.functions.tables import small_table
from colsight.operators import ranking

SHOWN_SAMPLES = 5
PREFIX_ROWS = 100
VOTE_SHARE = 0.9
KINDS = ("numeric", "categorical", "datetime", "boolean", "unknown")


@dataclass(frozen=True)
class ColumnKind:
    name: str
    kind: str
    position: int = 0
    missing_count: int | None = None
    sample_values: tuple[str, ...] = field(default=())
    date_layout: str | None = None


def of_kind(kinds: list[ColumnKind], *wanted: str) -> list[ColumnKind]:
    return [k for k in kinds if k.kind in wanted]


def name_column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kinds_from_schema(df: DataFrame, **overrides: str) -> list[ColumnKind]:
    """Kinds of an already typed table; ``overrides`` names a kind outright."""
    out = []
    for position, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.BooleanType):
            kind = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            kind = "numeric"
        elif isinstance(f.dataType, cells.TEMPORAL_TYPES):
            kind = "datetime"
        elif cells.is_text(f.dataType):
            kind = "categorical"
        else:
            kind = "unknown"
        out.append(ColumnKind(f.name, overrides.get(f.name, kind), position))
    return out


def normalize_missing(df: DataFrame) -> DataFrame:
    """Missing-value words in every text column become NULL; one projection."""
    return df.select(
        *[
            cells.normalize_missing(name_column(f.name)).alias(f.name)
            if cells.is_text(f.dataType) else name_column(f.name)
            for f in df.schema.fields
        ]
    )


def shown_samples(df: DataFrame, order_by: list[str] | None = None, shown: int = SHOWN_SAMPLES) -> DataFrame:
    """The first ``shown`` non-blank values of every column as ``(pos, sample_values)``, for display only.

    "First" is ingest order, or the order of ``order_by``. A short prefix answers for dense columns; the others are read
    in one further job, in which no task hands on more than ``shown`` values of a column.
    """
    order = [F.col(c) for c in order_by or []]
    text = {i: F.trim(name_column(n).cast("string")) for i, n in enumerate(df.columns)}
    first = (df.orderBy(*order) if order else df).limit(PREFIX_ROWS)
    prefix = first.select(*[c.alias(f"c{i}") for i, c in text.items()]).collect()
    found = {i: [r[i] for r in prefix if r[i]][:shown] for i in text}
    sparse = [i for i in text if len(found[i]) < shown] if len(prefix) == PREFIX_ROWS else []
    if sparse:
        key = {i: {"at": F.struct(*order, F.monotonically_increasing_id())} for i in sparse}
        cells = ranking.long_form(df, {i: text[i] for i in sparse}, key).where(F.col("value") != "")
        at = F.row_number().over(Window.partitionBy("pos").orderBy("at"))
        for i in sparse:
            found[i] = []
        for r in cells.withColumn("rank", at).where(F.col("rank") <= shown).orderBy("pos", "rank").collect():
            found[r["pos"]].append(r["value"])
    return small_table(df.sparkSession, list(found.items()), "pos int, sample_values array<string>")


def kind_votes(df: DataFrame) -> DataFrame:
    """``(pos, total_rows, missing, n, kind, date_layout)``: every non-blank cell of a column votes, in one aggregate over
    all rows: boolean, numeric, datetime, else categorical. The layout that reads most cells is elected."""
    v = F.col("value")
    need = F.ceil(F.col("n") * F.lit(VOTE_SHARE))
    text = {i: F.trim(name_column(f.name).cast("string")) for i, f in enumerate(df.schema.fields)}
    blank = {i: {"blank": cells.is_blank(name_column(f.name), f.dataType)} for i, f in enumerate(df.schema.fields)}
    said = F.coalesce(v, F.lit("")) != ""
    votes = ranking.long_form(df, text, blank).groupBy("pos").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("blank").alias("missing"),
        F.count_if(said).alias("n"),
        F.count_if(said & cells.boolean_like(v)).alias("booleans"),
        F.count_if(said & cells.numeric_like(v)).alias("numbers"),
        F.count_if(said & cells.date_like(v)).alias("dates"),
        *_layout_counts(v),
    )
    kind = (
        F.when(F.col("n") == 0, "unknown")
        .when(F.col("booleans") >= need, "boolean")
        .when(F.col("numbers") >= need, "numeric")
        .when(F.col("dates") >= need, "datetime")
        .otherwise("categorical")
    )
    return votes.select("pos", "total_rows", "missing", "n", kind.alias("kind"), F.when(kind == "datetime", _elected()).alias("date_layout"))


def _layout_counts(value: Column) -> list[Column]:
    return [F.count_if(cells.parse_date(value, name).isNotNull()).alias(f"as_{name}") for name in cells.DATE_LAYOUTS]


def _elected() -> Column:
    """The layout with most cells, the first of equal ones; none if no layout reads any."""
    best = F.greatest(*[F.col(f"as_{name}") for name in cells.DATE_LAYOUTS])
    return F.when(best > 0, F.coalesce(*[F.when(F.col(f"as_{name}") == best, F.lit(name)) for name in cells.DATE_LAYOUTS]))


def with_layouts(df: DataFrame, kinds: list[ColumnKind]) -> list[ColumnKind]:
    """The kinds, with a layout elected over all rows for each text column that is given as datetime without one."""
    open_ = {k.position: k for k in kinds if k.kind == "datetime" and k.date_layout is None and cells.is_text(df.schema[k.name].dataType)}
    if not open_:
        return kinds
    long = ranking.long_form(df, {p: F.trim(name_column(k.name)) for p, k in open_.items()})
    votes = long.where(F.col("value") != "").groupBy("pos").agg(*_layout_counts(F.col("value")))
    found = {r["pos"]: r["layout"] for r in votes.select("pos", _elected().alias("layout")).collect()}
    return [replace(k, date_layout=found.get(k.position)) if k.position in open_ and k.kind == "datetime" else k for k in kinds]


def infer_kinds_table(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per column: name, position, kind, missing count, sample values, date layout."""
    names = small_table(df.sparkSession, list(enumerate(df.columns)), "pos int, name string")
    return (
        names.join(F.broadcast(kind_votes(df)), "pos", "left")
        .join(F.broadcast(shown_samples(df, order_by)), "pos")
        .select(
            "name",
            F.col("pos").alias("position"),
            F.coalesce("kind", F.lit("unknown")).alias("kind"),
            F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing_count"),
            "sample_values",
            "date_layout",
        )
    )


def infer_kinds(df: DataFrame, order_by: list[str] | None = None) -> list[ColumnKind]:
    """Kinds of an all-text table by a vote over all its values per column."""
    rows = infer_kinds_table(df, order_by).collect()
    return [
        ColumnKind(r["name"], r["kind"], r["position"], r["missing_count"], tuple(r["sample_values"]), r["date_layout"])
        for r in sorted(rows, key=lambda r: r["position"])
    ]


def typed_cell(df: DataFrame, kind: ColumnKind) -> Column:
    cell, dtype = name_column(kind.name), df.schema[kind.name].dataType
    if kind.kind == "numeric":
        return cells.to_number(cell, dtype)
    if kind.kind == "datetime":
        return cells.to_timestamp(cell, dtype, kind.date_layout)
    if kind.kind == "boolean":
        return cells.to_boolean(cell, dtype)
    return cell


def apply_kinds(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """The typed table: double, timestamp_ntz, boolean or text per column."""
    return df.select(*[typed_cell(df, k).alias(k.name) for k in with_layouts(df, kinds)])
