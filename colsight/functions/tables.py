"""Small driver-made tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of a few driver rows (one per column, pair or bin).

    Going through Arrow makes it a local relation: broadcasting it costs no job.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = list(rows)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=schema)


def per_column(values: dict[int, object], kind: str = "double") -> Column:
    """The driver's value for each column position, looked up by ``pos``.

    A constant array of one entry per column: no join and no broadcast job.
    """
    listed = [F.lit(values.get(i)).cast(kind) for i in range(max(values, default=0) + 1)]
    return F.get(F.array(*listed), F.col("pos"))
