import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions import cells, special, text
from colsight.operators import kinds as K


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("token, value", [
    ("+5", 5.0), (".5", 0.5), ("5.", 5.0), (" 7 ", 7.0), ("1,234.5", 1234.5), ("1e3", 1000.0),
    ("1d", None), ("5f", None), ("NaN", None), ("inf", None), ("0x10", None), ("", None), ("1e999", None),
])
def test_number_coercion(spark, token, value):
    assert one(spark, cells.to_number(F.lit(token), T.StringType())) == value


@pytest.mark.parametrize("token, blank", [("NA", True), (" n/a ", True), ("--", True), ("", True), ("  ", True),
                                          ("#NULL!", True), ("nab", False), ("0", False)])
def test_missing_words(spark, token, blank):
    assert (one(spark, cells.normalize_missing(F.lit(token))) is None) is blank


@pytest.mark.parametrize("token, flag", [("Yes", True), (" t ", True), ("0", False), ("N", False), ("maybe", None)])
def test_booleans(spark, token, flag):
    assert one(spark, cells.to_boolean(F.lit(token), T.StringType())) is flag


def test_date_layouts_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [str(one(spark, cells.parse_date(F.lit(v), layout))) for v, layout in [
            ("2024-03-10 02:30:00", "iso_datetime"), ("3/9/2024", "month_day_year"), ("3/9/2024", "day_month_year"),
            ("2024/3/9", "year_month_day"), ("Mar 9, 2024", "month_name"), ("2024-03-09", "iso_date")]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 02:30:00", "2024-03-09 00:00:00", "2024-09-03 00:00:00", "2024-03-09 00:00:00",
                   "2024-03-09 00:00:00", "2024-03-09 00:00:00"]


def test_micros_round_trip(spark):
    for micros in (-1_500_000, 0, 1_709_294_401_000_007):
        ts = cells.from_epoch_micros(F.lit(micros).cast("bigint"))
        assert one(spark, cells.epoch_micros(ts)) == micros


@pytest.mark.parametrize("value, shown", [(0.0, "0"), (1234.0, "1.23k"), (1.5e6, "1.50M"), (2.5e9, "2.50B"),
                                          (12.34, "12.3"), (3.14159, "3.14"), (0.034, "0.034"), (0.00123, "1.23e-3"),
                                          (-0.00005, "-5.00e-5"), (1.2e-12, "1.20e-12")])
def test_compact_numbers(spark, value, shown):
    assert one(spark, text.compact_number(F.lit(value))) == shown


def test_other_formats(spark):
    assert one(spark, text.percent(F.lit(0.123))) == "12%"
    assert one(spark, text.percent(F.lit(0.0512))) == "5.1%"
    assert one(spark, text.percent(F.lit(0.0012))) == "0.12%"
    assert one(spark, text.percent(F.lit(None).cast("double"))) == "—"
    assert one(spark, text.stat_value(F.lit(2024.2), F.lit("year"))) == "2024"
    assert one(spark, text.p_value_text(F.lit(0.0001))) == "< 0.001"
    assert one(spark, text.p_value_text(F.lit(0.0042))) == "= 0.004"
    assert one(spark, text.file_size(F.lit(2048.0))) == "2.0 KB"
    assert one(spark, text.count_text(F.lit(1234567))) == "1,234,567"
    for items, shown in [(["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")]:
        assert one(spark, text.join_list(F.array(*[F.lit(i) for i in items]))) == shown


def test_normal_tails(spark):
    zs = [-9.0, -5.0, -1.3, -0.2, 0.0, 0.2, 1.0, 2.5, 6.0, 8.0, 30.0]
    far = special.log_far_tail(F.col("z"))
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(
        "z", far.alias("far"), special.log_near_tail(far).alias("near"), special.normal_two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        tail = 0.5 * math.erfc(abs(r.z) / math.sqrt(2))
        assert r.far == pytest.approx(math.log(tail), rel=1e-12)
        assert r.near == pytest.approx(math.log1p(-tail), rel=1e-9, abs=1e-300)
        assert r.p == pytest.approx(2 * tail, rel=1e-12)


@pytest.mark.parametrize("t, dof, p", [  # published two-sided critical values
    (12.706, 1, 0.05), (2.228, 10, 0.05), (2.086, 20, 0.05), (2.845, 20, 0.01), (1.960, 10**9, 0.05), (0.0, 7, 1.0)])
def test_student_t(t, dof, p):
    assert special.t_two_sided_p(t, dof) == pytest.approx(p, abs=6e-5)


def test_student_t_closed_forms():
    for t in (0.1, 0.7, 1.0, 3.0, 25.0):
        assert special.t_two_sided_p(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-10)
        assert special.t_two_sided_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-5, 0.02, 0.03, 0.2, 0.5, 0.7, 0.97, 0.98, 0.99999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p"), 1 - F.col("p")).alias("z")).collect()
    assert [r["z"] for r in rows] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-8)


def test_kind_inference(spark):
    rows = [(f"C{i}", f"2024-01-{1 + i:02d}", f"{i},000.5", "yes" if i % 2 else "n", "NA", "1" if i % 2 else "0",
             "x" if i == 0 else str(i)) for i in range(20)]
    df = K.normalize_missing(spark.createDataFrame(rows, "id string, day string, amount string, flag string, none string, bit string, mostly string"))
    found = {k.name: k for k in K.infer_kinds(df)}
    assert {n: k.kind for n, k in found.items()} == {
        "id": "categorical", "day": "datetime", "amount": "numeric", "flag": "boolean", "none": "unknown",
        "bit": "boolean", "mostly": "numeric"}
    assert found["none"].missing_count == 20 and found["id"].sample_values == ("C0", "C1", "C2", "C3", "C4")
    typed = K.apply_kinds(df, list(found.values()))
    assert dict(typed.dtypes)["day"] == "timestamp_ntz" and dict(typed.dtypes)["amount"] == "double"


def test_samples_of_late_columns_are_the_first_ones(spark):
    late = F.when(F.col("id") >= 4000, F.col("id").cast("string"))
    df = spark.range(5000).select(F.col("id"), late.alias("late"), F.lit(" ").alias("none"), F.col("id").cast("string").alias("full")).repartition(7)
    got = {r["pos"]: r["sample_values"] for r in K.shown_samples(df, ["id"]).collect()}
    assert got[1] == ["4000", "4001", "4002", "4003", "4004"] and got[2] == [] and got[3] == ["0", "1", "2", "3", "4"]


def test_every_row_votes(spark):
    words = F.when(F.col("id") < 1000, F.col("id").cast("string")).otherwise("word")
    some = F.when(F.col("id") % 20 == 0, "word").otherwise(F.col("id").cast("string"))
    df = spark.range(5000).select(words.alias("wordy"), some.alias("mostly"))
    found = {k.name: k for k in K.infer_kinds(df)}
    assert found["wordy"].kind == "categorical" and found["mostly"].kind == "numeric"
    assert found["wordy"].sample_values == ("0", "1", "2", "3", "4")


def test_given_datetimes_keep_their_times(spark):
    rows = [(f"2024-01-{1 + i:02d} 10:{i:02d}", f"2024-02-{1 + i:02d}", f"{13 + i}/{1 + i}/2024", "2024-03-01") for i in range(9)]
    df = spark.createDataFrame(rows, "at string, day string, slashes string, note string")
    kinds = K.kinds_from_schema(df, at="datetime", day="datetime", slashes="datetime")
    assert [k.date_layout for k in K.with_layouts(df, kinds)] == ["iso_datetime", "iso_date", "day_month_year", None]
    typed = K.apply_kinds(df, kinds).collect()
    assert str(typed[3]["at"]) == "2024-01-04 10:03:00" and str(typed[0]["slashes"]) == "2024-01-13 00:00:00"
    assert all(v is not None for r in typed for v in r)


def test_date_format_election(spark):
    df = spark.createDataFrame([(f"{d}/{m}/2024",) for m in (1, 2) for d in range(10, 25)], "d string")
    kind = K.infer_kinds(df)[0]
    assert (kind.kind, kind.date_layout) == ("datetime", "day_month_year")
