"""Cell-level column expressions: missing tests, kind predicates and coercions.

Every function takes a Column (plus, where it matters, the column's Spark type)
and returns a Column, so that all of it stays inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: cell vocabulary and patterns ------------------------------
MISSING_WORDS = ("na", "n/a", "null", "nan", "#n/a", "#na", "-", "--", "#null!")
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
NUMERIC_LIKE = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
NUMERIC_COERCIBLE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_SEPARATOR = r"[-/:]"
# --- end of fixed values -----------------------------------------------------

# Accepted date layouts, in election order: name -> (shape test, Spark pattern).
# ISO date-times have no pattern: they go through the cast to TIMESTAMP_NTZ.
DATE_LAYOUTS: dict[str, tuple[str, str | None]] = {
    "iso_date": (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    "iso_datetime": (r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$", None),
    "month_day_year": (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    "day_month_year": (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    "year_month_day": (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    "month_name": (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
}

# Layouts that no other one can be taken for; without an election these are read.
CLEAR_LAYOUTS = ("iso_date", "iso_datetime", "year_month_day", "month_name")

NUMERIC_TYPES = (T.NumericType,)
TEMPORAL_TYPES = (T.TimestampNTZType, T.TimestampType, T.DateType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def normalize_missing(cell: Column) -> Column:
    """Missing-value words and blank strings become NULL; other text is kept."""
    word = F.lower(F.trim(cell))
    return F.when(word.isin("", *MISSING_WORDS), None).otherwise(cell)


def is_blank(cell: Column, dtype: T.DataType) -> Column:
    """The missing test. Only text can be blank; floats are missing when NaN."""
    if is_text(dtype):
        return cell.isNull() | (F.trim(cell) == "")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return cell.isNull() | F.isnan(cell)
    return cell.isNull()


# ----- kind predicates (on trimmed, non-blank text) --------------------------


def boolean_like(cell: Column) -> Column:
    return F.lower(cell).isin(*TRUE_WORDS, *FALSE_WORDS)


def numeric_like(cell: Column) -> Column:
    return F.replace(cell, F.lit(","), F.lit("")).rlike(NUMERIC_LIKE)


def date_like(cell: Column) -> Column:
    parsed = F.coalesce(*[parse_date(cell, name) for name in DATE_LAYOUTS])
    return cell.rlike(DATE_SEPARATOR) & parsed.isNotNull()


# ----- coercions -------------------------------------------------------------


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def to_number(cell: Column, dtype: T.DataType) -> Column:
    """A finite double, or NULL when the cell does not hold a number."""
    if is_text(dtype):
        plain = F.replace(cell, F.lit(","), F.lit(""))
        return F.when(
            plain.rlike(NUMERIC_COERCIBLE), finite(F.trim(plain).try_cast("double"))
        )
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(cell.cast("double"))
    if isinstance(dtype, (*NUMERIC_TYPES, T.BooleanType)):
        return cell.cast("double")
    return F.lit(None).cast("double")


def to_boolean(cell: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return cell
    word = F.lower(F.trim(cell.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_date(cell: Column, layout: str) -> Column:
    """Read one named layout; independent of the session time zone."""
    shape, pattern = DATE_LAYOUTS[layout]
    text = F.trim(cell)
    if pattern is None:
        parsed = text.try_cast("timestamp_ntz")
    else:
        parsed = F.try_to_date(text, pattern).cast("timestamp_ntz")
    return F.when(text.rlike(shape), parsed)


def to_timestamp(cell: Column, dtype: T.DataType, layout: str | None = None) -> Column:
    if isinstance(dtype, TEMPORAL_TYPES):
        return cell.cast("timestamp_ntz")
    if not is_text(dtype):
        return F.lit(None).cast("timestamp_ntz")
    if layout is not None:
        return parse_date(cell, layout)
    return F.coalesce(*[parse_date(cell, name) for name in CLEAR_LAYOUTS])


def epoch_micros(ts: Column) -> Column:
    """TIMESTAMP_NTZ as whole microseconds since 1970 (unix_micros refuses NTZ)."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts)


def from_epoch_micros(micros: Column) -> Column:
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # TIMESTAMPADD takes an INT quantity: add whole seconds and the rest apart.
    day = F.floor(micros / F.lit(86_400_000_000.0)).cast("int")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    second = F.floor(rest / F.lit(1_000_000.0)).cast("int")
    micro = F.pmod(rest, F.lit(1_000_000)).cast("int")
    out = F.timestamp_add("DAY", day, origin)
    return F.timestamp_add("MICROSECOND", micro, F.timestamp_add("SECOND", second, out))
