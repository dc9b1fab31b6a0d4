"""Number, share, date and list formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def compact_number(value: Column) -> Column:
    """B / M / k units from a thousand up, one to three decimals below, exponent under 0.01."""
    size = F.abs(value)
    exponent = F.regexp_replace(F.format_string("%.2e", value.cast("double")), r"e([+-])0*(\d)", "e$1$2")
    return (
        F.when(value.isNull() | F.isnan(value.cast("double")), NOTHING)
        .when(size == 0, "0")
        .when(size >= 1e9, F.concat(fixed(value / F.lit(1e9), 2), F.lit("B")))
        .when(size >= 1e6, F.concat(fixed(value / F.lit(1e6), 2), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(value / F.lit(1e3), 2), F.lit("k")))
        .when(size >= 10, fixed(value, 1))
        .when(size >= 1, fixed(value, 2))
        .when(size >= 0.01, fixed(value, 3))
        .otherwise(exponent)
    )


def stat_value(value: Column, hint: Column) -> Column:
    """Years print as whole numbers, everything else compactly."""
    year = F.floor(value + F.lit(0.5)).cast("bigint").cast("string")
    return F.when((hint == "year") & value.isNotNull(), year).otherwise(compact_number(value))


def percent(share: Column) -> Column:
    pct = share * F.lit(100.0)
    return (
        F.when(share.isNull() | F.isnan(share.cast("double")), NOTHING)
        .when(F.abs(pct) >= 10, F.concat(fixed(pct, 0), F.lit("%")))
        .when(F.abs(pct) >= 1, F.concat(fixed(pct, 1), F.lit("%")))
        .otherwise(F.concat(fixed(pct, 2), F.lit("%")))
    )


def short_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NOTHING))


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def p_value_text(p: Column) -> Column:
    return (
        F.when(p < 0.001, "< 0.001")
        .when(p < 0.01, F.concat(F.lit("= "), fixed(p, 3)))
        .otherwise(F.concat(F.lit("= "), fixed(p, 2)))
    )


def short_p_value(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").when(p < 0.01, fixed(p, 3)).otherwise(fixed(p, 2))


def file_size(size: Column) -> Column:
    kib, mib = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return (
        F.when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(fixed(size / kib, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(size / mib, 2), F.lit(" MB")))
    )


def join_list(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.element_at(items, -1)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat(head, F.lit(" and "), last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )
