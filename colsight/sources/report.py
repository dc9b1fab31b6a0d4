"""The combined result as one nested row, scrubbed of NaN and infinities, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.cells import finite
from colsight.functions.tables import small_table
from colsight.operators.kinds import name_column


def scrub_cell(cell: Column, dtype: T.DataType) -> Column:
    """NaN and infinite doubles become NULL, inside arrays and structs too."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(cell)
    if isinstance(dtype, T.ArrayType):
        return F.transform(cell, lambda x: scrub_cell(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        inner = [scrub_cell(cell[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(cell.isNotNull(), F.struct(*inner))
    return cell


def scrub(df: DataFrame) -> DataFrame:
    """A result table without NaN or infinite values."""
    return df.select(*[scrub_cell(name_column(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def folded(table: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A bounded result table as one row with one array column, in a fixed order."""
    cols = [F.col(c) for c in order] + [name_column(c) for c in table.columns]
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols[:len(order)])],
                     F.struct(*[name_column(c) for c in table.columns]).alias("row"))
    return table.agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["row"]).alias(name))


def combine(spark, parts: dict[str, tuple[DataFrame, list[str]]], **facts: tuple[str, object]) -> DataFrame:
    """One nested report row; ``facts`` are (type, value) scalars."""
    base = small_table(
        spark, [(0, *[v for _, v in facts.values()])],
        ", ".join(["one int", *[f"{n} {t}" for n, (t, _) in facts.items()]]),
    ).withColumn("generated_at", F.current_timestamp())
    for name, (table, order) in parts.items():
        base = base.join(F.broadcast(folded(scrub(table), name, order).withColumn("one", F.lit(0))), "one")
    return base.drop("one")


def long_rows(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """The bounded result tables as rows (part, at, record): a record is a JSON object without its empty fields, ``at``
    its place in the part's fixed order. No clock, so equal inputs give equal rows."""
    out = None
    for name, (table, order) in parts.items():
        place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
        rows = scrub(table).select(F.lit(name).alias("part"), place.cast("int").alias("at"), F.to_json(F.struct(*[name_column(c) for c in table.columns])).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str, mode: str = "errorifexists") -> None:
    """Every result as a Parquet table ``path/<name>``, partitioned by its columns; ``path/manifest`` is written last.

    Nothing is collected, so tables as long as the input are fine. A folder without a manifest is not complete.
    """
    listed = []
    for name, (table, keys) in tables.items():
        scrub(table).write.mode(mode).partitionBy(*keys).parquet(f"{path}/{name}")
        listed.append((name, ",".join(keys), table.schema.simpleString()))
    spark = next(iter(tables.values()))[0].sparkSession
    small_table(spark, listed, "name string, partitioned_by string, columns string").coalesce(1).write.mode(mode).json(f"{path}/manifest")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that a manifest names."""
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.json(f"{path}/manifest").collect()}


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write the report row as JSON or Parquet."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown report format: {fmt}")
    report.write.mode(mode).format(fmt).save(path)


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))
