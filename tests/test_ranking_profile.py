from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.functions.special import francia_p
from colsight.operators import findings, kinds as K, profile as P, ranking as R


def francia(x):
    """Squared correlation of sorted values with normal scores, ties at their mean rank."""
    rank = pd.Series(x).rank().to_numpy()
    m = np.array([NormalDist().inv_cdf((r - 0.375) / (len(x) + 0.25)) for r in rank])
    return np.corrcoef(x, m)[0, 1] ** 2


def numbers(spark, columns: dict):
    pdf = pd.DataFrame({k: pd.array(v, dtype="float64") for k, v in columns.items()})
    return spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in pdf.to_numpy()],
                                 ", ".join(f"{c} double" for c in columns))


def panel(spark, columns: dict, **options):
    df = numbers(spark, columns)
    out = P.profile_numeric(df, K.kinds_from_schema(df), **options)
    return {r["name"]: r.asDict() for r in out.summary.collect()}, out


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("bucket_values", [7, 100, 10**6])
def test_rank_equals_sorted_position(spark, partitions, bucket_values):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(400, 3.0), rng.normal(size=300).round(1), rng.normal(size=500)])
    rng.shuffle(values)
    df = spark.createDataFrame([(0, float(v)) for v in values], "pos int, value double").repartition(partitions)
    ranked = R.with_rows_before(R.count_values(df), bucket_values=bucket_values)
    got = {r["value"]: (r["before"], r["rank"]) for r in ranked.select("value", "before", R.average_rank().alias("rank")).collect()}
    expected = pd.Series(values).rank(method="average")
    for v, rank in zip(values, expected):
        before, avg = got[float(v)]
        assert before == int((values < v).sum()) and avg == rank


def test_selection_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(R, "SELECT_ROWS", 20)
    rng = np.random.default_rng(1)
    columns = {0: rng.lognormal(sigma=6, size=3000), 1: np.repeat([1.0, 2.0, 9.0], 500), 2: np.array([4.0]),
               3: np.concatenate([[-1.5e308, 1.5e308], np.arange(99.0)])}
    rows = [(p, float(v), 1) for p, vs in columns.items() for v in vs]
    df = R.hold(spark.createDataFrame(rows, "pos int, value double, cnt bigint"))
    got = R.medians(df)
    for p, vs in columns.items():
        assert got[p] == pytest.approx(np.median(vs), rel=1e-12)
    ranks = {0: {0, 17, 1499, 2999}}
    at = R.order_statistics(df, ranks)
    for k in ranks[0]:
        assert at[0, k] == np.sort(columns[0])[k]


def test_numeric_panel_against_pandas(spark):
    rng = np.random.default_rng(11)
    data = {"plain": rng.normal(50, 9, 700), "mixed": rng.standard_t(2, 700) * 10, "gaps": np.where(rng.random(700) < 0.3, np.nan, rng.gamma(1.0, 3, 700))}
    got, _ = panel(spark, data)
    for name, raw in data.items():
        s = pd.Series(raw).dropna()
        r = got[name]
        assert r["count"] == len(s) and r["missing"] == 700 - len(s)
        for field, value in {"mean": s.mean(), "std": s.std(), "skew": s.skew(), "kurtosis_excess": s.kurt(), "median": s.median(),
                             "p1": s.quantile(0.01), "p95": s.quantile(0.95), "min": s.min(), "max": s.max()}.items():
            assert r[field] == pytest.approx(value, rel=1e-9), (name, field)
        mad = (s - s.median()).abs().median() * 1.4826
        assert r["mad"] == pytest.approx(mad, rel=1e-12)
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert r["outlier_iqr_count"] == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
        assert r["outlier_robust_count"] == int((0.6745 * (s - s.median()).abs() / mad > 3.5).sum())
        a = np.sort(np.abs(s))
        gini = 2 * (np.arange(1, len(a) + 1) * a).sum() / (len(a) * a.sum()) - (len(a) + 1) / len(a)
        assert r["gini"] == pytest.approx(gini, rel=1e-9)
        w = francia(s.to_numpy())
        assert r["normality_test"] == "shapiro_francia" and r["normality_statistic"] == pytest.approx(w, rel=1e-7)
        assert r["normality_p"] == pytest.approx(francia_p(w, len(s)), abs=1e-6)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"skewed": rng.exponential(5, 900), "grid": np.tile(np.arange(0, 1.0001, 0.1), 82)[:900]}
    _, out = panel(spark, data)
    for name, raw in data.items():
        rows = sorted((r["bin"], r["cnt"], r["bin_lo"]) for r in out.histogram.where(F.col("name") == name).collect())
        counts, edges = np.histogram(raw, bins=len(rows))
        assert [c for _, c, _ in rows] == list(counts)
        assert [lo for _, _, lo in rows] == pytest.approx(list(edges[:-1]))


def test_edge_columns(spark):
    n = 40
    data = {"constant": [7.0] * n, "spike": [5.0] * 36 + [1.0, 2.0, 8.0, 9.0], "ties": [1.0, 2.0, 2.0, 3.0] * 10,
            "zeros": [0.0] * 30 + [-1.0] * 5 + [1.0] * 5, "single": [4.0] + [np.nan] * (n - 1), "none": [np.nan] * n,
            "wild": [np.inf, -np.inf] + [1.0] * 19 + [2.0] * 19}
    got, out = panel(spark, data)
    bins = out.histogram.groupBy("name").agg(F.count("*").alias("k"), F.sum("cnt").alias("n")).collect()
    k = {r["name"]: (r["k"], r["n"]) for r in bins}
    c = got["constant"]
    assert (c["std"], c["cv"], c["gini"], c["mad"], k["constant"]) == (0.0, 0.0, pytest.approx(0.0, abs=1e-12), 0.0, (1, n))
    assert (got["spike"]["iqr"], got["spike"]["mad"], got["spike"]["outlier_iqr_count"], k["spike"]) == (0.0, 0.0, 0, (1, n))
    assert k["ties"] == (2, n)  # whole numbers keep bins at least one wide
    z = got["zeros"]
    assert z["zeros_count"] == 30 and z["cv"] is None and z["mean"] == 0.0
    s = got["single"]
    assert (s["count"], s["std"], s["skew"], s["mad"]) == (1, 0.0, 0.0, 0.0) and "single" not in k
    assert "none" not in got and out.unusable[0][5] == P.NO_NUMBERS
    assert got["wild"]["count"] == n - 2 and got["wild"]["max"] == 2.0


def test_one_normality_test_at_every_size(spark):
    rng = np.random.default_rng(8)
    for n in (4999, 5001):
        data = {"bell": rng.normal(size=n), "ties": rng.normal(size=n).round(1), "skew": rng.exponential(size=n)}
        got, _ = panel(spark, data)
        for name, x in data.items():
            assert got[name]["normality_test"] == "shapiro_francia"
            assert got[name]["normality_statistic"] == pytest.approx(francia(x), rel=1e-7)
        assert got["bell"]["normality_p"] > 0.01 and got["skew"]["normality_p"] < 1e-12
    p = [francia_p(francia(rng.normal(size=60)), 60) for _ in range(400)]
    assert 0.44 < np.mean(p) < 0.56 and 0.02 < np.mean(np.array(p) < 0.05) < 0.09


def test_selection_takes_three_passes_on_a_heavy_tail(spark):
    x = np.random.default_rng(4).lognormal(sigma=9, size=60_000)
    df = R.hold(spark.createDataFrame(pd.DataFrame({"pos": np.zeros(len(x), "int32"), "value": x, "cnt": np.ones(len(x), "int64")})))
    passes = []
    at = R.order_statistics(df, {0: {0, 100, 30_000, 59_990}}, passes=passes)
    assert [at[0, k] for k in (0, 100, 30_000, 59_990)] == np.sort(x)[[0, 100, 30_000, 59_990]].tolist()
    assert passes == ["sketch", "count", "read"]
    same = R.hold(spark.createDataFrame([(0, v, 1) for v in [1.0, 9.0, *[2.0] * 6000]], "pos int, value double, cnt bigint"))
    assert R.order_statistics(same, {0: {0, 1, 6000, 6001}}) == {(0, 0): 1.0, (0, 1): 2.0, (0, 6000): 2.0, (0, 6001): 9.0}


def test_outliers_repeat_values_up_to_the_limit(spark):
    got, out = panel(spark, {"x": list(np.linspace(0, 1, 300)) + [50.0] * 45 + [60.0] * 10})
    spots = sorted((r["rank"], r["value"]) for r in out.outliers.collect())
    assert got["x"]["outlier_robust_count"] == 55
    assert spots == [(i, 60.0) for i in range(1, 11)] + [(i, 50.0) for i in range(11, 51)]


@pytest.mark.parametrize("bucket_values", [2, 10**6])
def test_gaps_across_ranges(spark, bucket_values):
    at = [0, 0, 5, 9, 9, 9, 30, 31, 100]
    df = spark.createDataFrame([(0, v) for v in at], "pos int, value bigint")
    instants = R.count_values(df)
    got = {r["value"]: r["cnt"] for r in P.gap_table(instants, R.column_sizes(instants), bucket_values).collect()}
    assert got == pd.Series(np.diff(at)).value_counts().to_dict()


def test_profile_of_every_kind(spark):
    df = spark.createDataFrame(
        [(f"r{i}", "ab"[i % 2], f"2024-01-{1 + i:02d}" if i != 4 else None, "yes" if i < 9 else "no", str(i)) for i in range(12)],
        "id string, grp string, day string, ok string, n string")
    kinds = [K.ColumnKind("id", "categorical", 0), K.ColumnKind("grp", "categorical", 1),
             K.ColumnKind("day", "datetime", 2, date_layout="iso_date"), K.ColumnKind("ok", "boolean", 3), K.ColumnKind("n", "geo", 4)]
    p = P.profile(df, kinds)
    cat = {r["name"]: r for r in p.categorical.collect()}
    assert cat["id"]["unique_count"] == 12 and cat["grp"]["mode"] == "a" and cat["grp"]["entropy_normalized"] == pytest.approx(1.0)
    day = p.datetime.first()
    assert (day["missing"], day["range_days"], day["granularity"], day["gap_count"]) == (1, 11, "daily", 1)
    assert p.boolean.first()["true_pct"] == 0.75
    assert "geo" in p.unknown.first()["reason"]
    assert [r["name"] for r in P.missing_report(p).collect()] == ["day"]
    assert [r["name"] for r in P.columns_by_kind(p).collect()] == ["id", "grp", "day", "ok", "n"]


def test_all_tied_leaders_are_counted(spark):
    df = spark.createDataFrame([(f"v{i % 8}",) for i in range(80)] + [("w",)] * 3, "c string")
    kinds = K.kinds_from_schema(df)
    counts = P.category_counts(df, kinds)
    summary = P.categorical_summary(df, counts, kinds)
    assert summary.first()["tied_count"] == 8
    found = findings.categorical_findings(summary, P.top_values_table(counts, kinds)).where("position = 0").first()
    assert found["rule"] == "tied_lead" and "3 more" in found["headline"] and found["body"].startswith("tied_values=8; ")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string, c timestamp_ntz, d boolean")
    p = P.profile(df)
    assert p.row_count == 0 and p.unknown.count() == 4


def test_no_single_task_window_over_rows(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("pos"), F.col("id").cast("double").alias("value"))
    plan = R.with_rows_before(R.count_values(df), bucket_values=10)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
