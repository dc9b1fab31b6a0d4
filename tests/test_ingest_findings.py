import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from colsight.operators import findings as R, relate, segment
from colsight.plans.analyze import analyze
from colsight.sources import delimited as D, report

RAGGED = 'id,name,amount\n1,"Smith, Ann","1,200"\n\n2,"said ""hi""",5\n3,short\n , ,\n4,long,7,extra\n5,"two\nlines",9\n'


def check_ragged(source):
    rows = {r["id"]: r for r in source.rows.collect()}
    assert list(rows) == ["1", "2", "3", "4", "5"]
    assert rows["1"]["name"] == "Smith, Ann" and rows["1"]["amount"] == "1,200"
    assert rows["2"]["name"] == 'said "hi"' and rows["5"]["name"] == "two\nlines"
    assert rows["3"]["amount"] is None and rows["4"]["amount"] == "7"
    assert [(r["row"], r["text"].split(",")[0]) for r in source.malformed().orderBy("row").collect()] == [(3, "3"), (4, "4")]


def test_ragged_text(spark):
    check_ragged(D.read_text(spark, RAGGED))


def test_ragged_file(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text(RAGGED)
    source = D.read_delimited(spark, str(path))
    check_ragged(source)
    assert D.large_input_notice(source) is None
    assert "5 rows" in D.large_input_notice(source, max_rows=5)


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choice(['a', ' ', '"', '\n', ',', 'é', '\n\n']) for _ in range(rng.randrange(30))) + "." + "x\n" * (400 if i == 50 else 0), "end") for i in range(300)]
    for name, newline in (("plain", "\n"), ("returns", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerows([("id", "text", "last"), *rows])
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            for limit in ("128m", "700"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
                spark.conf.set("spark.sql.files.openCostInBytes", "0")
                found = D.read_delimited(spark, str(tmp_path / f"{name}.csv"))
                assert limit == "128m" or found.parsed.rdd.getNumPartitions() > 5
                assert sorted((r["id"], r["text"], r["last"]) for r in found.rows.collect()) == sorted(rows)
                assert found.malformed().count() == 0
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,name,amount\n1,x,5\n2,y,6\n")
    (tmp_path / "b.csv").write_text("\namount,id,more\n7,3,m\n,,\n8,4,n,extra\n")
    (tmp_path / "c.txt").write_text("id,name,amount\n")
    found = D.read_delimited(spark, str(tmp_path))
    assert found.headers == ["id", "name", "amount", "more"]
    assert sorted(tuple(r) for r in found.rows.collect()) == [("1", "x", "5", None), ("2", "y", "6", None), ("3", None, "7", "m"), ("4", None, "8", "n")]
    assert [(r["row"], r["text"]) for r in found.malformed().collect()] == [(4, "8,4,n,extra")]
    (tmp_path / "d.pdf").write_text("id,name\n1,2\n")
    with pytest.raises(D.InputError, match="d.pdf"):
        D.read_delimited(spark, str(tmp_path))


def test_delimiter_by_all_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b,c;d\n" + "1;2,5;3\n" * 30 + "1;2;3\n" * 40)
    assert D.read_delimited(spark, str(tmp_path / "a.csv")).headers == ["a", "b,c", "d"]


def test_delimiters_and_guards(spark, tmp_path):
    assert D.read_text(spark, "a;b\n1;2\n3;4\n").headers == ["a", "b"]
    assert D.read_text(spark, "a\tb\n1,5\t2\n").rows.first()["a"] == "1,5"
    for empty in ("", "a,b\n", "\n\n"):
        with pytest.raises(D.InputError):
            D.read_text(spark, empty)
    with pytest.raises(D.InputError):
        D.read_delimited(spark, str(tmp_path / "x.pdf"))


def test_preview(spark):
    df = spark.createDataFrame([("a" * 50, None), ("b", "  ")], "x string, y string")
    rows = D.preview(df, ["x"]).collect()
    assert rows[0]["x"] == "a" * 40 + "…" and rows[0]["y"] == rows[1]["y"] == "·"


def test_scrub(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "a double, b array<double>")
    row = report.scrub(df).first()
    assert row["a"] is None and row["b"] == [1.0, None]


def numeric_row(spark, **changes):
    base = dict(name="x", total_rows=100, missing=0, missing_pct=0.0, count=100, mean=10.0, std=5.0, cv=0.5, median=9.5, min=1.0,
                max=20.0, p99=19.0, skew=0.1, kurtosis_excess=0.0, normality_p=None, outlier_robust_count=0, gini=0.2, zeros_count=0,
                format_hint="standard")
    base.update(changes)
    kinds = {"name": "string", "format_hint": "string", "total_rows": "bigint", "missing": "bigint", "count": "bigint",
             "outlier_robust_count": "bigint", "zeros_count": "bigint"}
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base))
    return [(r["rule"], r["severity"], r["headline"]) for r in R.numeric_findings(df).orderBy("position").collect()]


@pytest.mark.parametrize("changes, expected", [
    ({}, [("range", "info", "Average 10.0, median 9.50.")]),
    ({"std": 0.0, "cv": 0.0}, [("constant", "warning", "Every row has the same value (10.0).")]),
    ({"skew": 2.0}, [("strong_skew", "info", "Most rows sit around 9.50, with a long tail of high values.")]),
    ({"skew": -0.7}, [("mild_skew", "info", "Average 10.0, median 9.50.")]),
    ({"normality_p": 0.3}, [("normal_like", "info", "Average 10.0, median 9.50.")]),
    ({"cv": 1.2, "kurtosis_excess": 4.0}, [("range", "info", "Average 10.0, median 9.50."), ("spread_wide", "note", "Values vary widely (CV 1.20)."),
     ("heavy_tails", "note", "Extreme values show up more often than a typical bell curve would predict.")]),
    ({"outlier_robust_count": 1}, [("range", "info", "Average 10.0, median 9.50."), ("outliers", "note", "1 unusual value stands out.")]),
    ({"outlier_robust_count": 6, "gini": 0.6}, [("range", "info", "Average 10.0, median 9.50."), ("outliers", "warning", "6 unusual values stand out."),
     ("concentration", "info", "A small group at the top drives most of the total.")]),
    ({"zeros_count": 60}, [("range", "info", "Average 10.0, median 9.50."), ("mostly_zeros", "warning", "Mostly zeros (60%).")]),
    ({"missing_pct": 0.25, "missing": 25}, [("range", "info", "Average 10.0, median 9.50."), ("missing_high", "warning", "25% of rows are missing a value here.")]),
    ({"mean": 2010.4, "median": 2011.0, "format_hint": "year"}, [("range", "info", "Average 2010, median 2011.")]),
])
def test_numeric_rules(spark, changes, expected):
    assert numeric_row(spark, **changes) == expected


def logistic_rules(spark, auc, n, true, odds=1.5, p=0.01):
    model = spark.createDataFrame([("y", "logistic", n, None, None, None, auc, 0.9, true, n - true, [], None, True, 5)], relate.MODEL_SCHEMA)
    terms = spark.createDataFrame([("y", "logistic", 1, "x", 0.4, 0.5, 0.1, 4.0, p, p < 0.05, odds, None)], relate.COEFFICIENT_SCHEMA)
    return [(r["rule"], r["severity"]) for r in R.logistic_findings(model, terms).orderBy("position").collect()]


def test_logistic_rules(spark):
    assert logistic_rules(spark, 0.99, 40, 20)[0] == ("auc_perfect", "warning")
    assert logistic_rules(spark, 0.99, 500, 250) == [("auc_strong", "info"), ("top_predictor", "info")]
    assert logistic_rules(spark, 0.99, 500, 250, p=0.8) == [("auc_perfect", "warning"), ("top_predictor", "note")]
    assert logistic_rules(spark, 0.65, 500, 50) == [("auc_weak", "note"), ("top_predictor", "info"), ("class_imbalance", "warning")]
    assert logistic_rules(spark, 0.5, 45, 20) == [("auc_none", "warning"), ("top_predictor", "info"), ("small_sample", "note")]


@pytest.mark.parametrize("score, rule", [(0.6, "groups_clear"), (0.4, "groups_fair"), (0.3, "groups_fuzzy"), (0.1, "groups_weak")])
def test_segment_rules(spark, score, rule):
    s = spark.createDataFrame([(3, score, "centroid", 2, 50, 0.6, 0.3, None, True, 4)], segment.SUMMARY_SCHEMA)
    assert [r["rule"] for r in R.segment_findings(s).orderBy("position").collect()] == [rule, "projection"]


def test_display_bands(spark):
    rows = [("a", "linear", 9, 0.8, 0.8, 0.0, None, None, None, None, [], None, True, 1), ("b", "logistic", 9, None, None, 0.0, 0.7, 0.5, 4, 5, [], None, True, 6),
            ("c", "linear", 0, 0.0, 0.0, None, None, None, None, None, [], "why", None, None)]
    got = {r["target"]: r["band"] for r in R.quality_band(spark.createDataFrame(rows, relate.MODEL_SCHEMA)).collect()}
    assert got == {"a": "good", "b": "fair", "c": "skipped"}
    marks = R.deviation_marks(spark.createDataFrame([(0, 1, "f", 1.0, 0.6), (0, 2, "g", 1.0, -0.2)], segment.FEATURE_SCHEMA)).collect()
    assert [(m["arrow"], m["tone"]) for m in marks] == [("up", "high"), ("down", "neutral")]


def sales_csv():
    lines = ["date,spend,revenue,visits,channel,active"]
    for i in range(24):
        spend = 1000 + 37 * i + (i * 53) % 91
        lines.append(f'2024-{1 + i // 4:02d}-{1 + 7 * (i % 4):02d},"{spend:,}",{4 * spend + (i * 29) % 61},{spend // 25 + i % 3},{"abc"[i % 3]},{"yes" if (i * 7) % 5 < 2 else "no"}')
    return "\n".join(lines) + "\n"


def test_whole_analysis(spark, tmp_path):
    a = analyze(D.read_text(spark, sales_csv()).rows)
    assert [k.kind for k in a.kinds] == ["datetime", "numeric", "numeric", "numeric", "categorical", "boolean"]
    assert a.relations.pearson.count() == 9 and a.relations.models.count() == 4
    assert a.segments.summary.first()["skipped_reason"] is None
    assert a.trends.trends.count() == 3
    assert {"column", "pair", "linear", "logistic", "segments", "cluster", "trend"} == {r["section"] for r in a.findings.collect()}
    assert a.findings.where(F.col("headline").isNull()).count() == 0
    report.write_report(a.report, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    loaded = json.loads(text[0]["value"])
    assert len(text) == 1 and loaded["row_count"] == 24 and len(loaded["numeric"]) == 3 and len(loaded["pearson"]) == 9
    assert sum(c["n"] for c in loaded["projection"]) == 24
    rows = report.long_rows(a.parts).collect()
    assert {r["part"] for r in rows} >= {"numeric", "findings", "clusters"} and sum(r["part"] == "numeric" for r in rows) == 3
    report.write_tables(a.tables(), str(tmp_path / "tables"))
    tables = report.read_tables(spark, str(tmp_path / "tables"))
    assert tables["projection"].count() == 24 and tables["history"].count() == a.trends.history.count() and tables["numeric"].count() == 3
    report.write_report(a.report, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_analysis_without_numbers(spark):
    a = analyze(spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string"))
    assert a.relations.models.count() == 0 and a.trends.skipped_reason and a.segments.summary.first()["skipped_reason"]
