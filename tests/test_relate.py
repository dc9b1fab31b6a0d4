import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import kinds as K, moments as M, relate as R


def frame(spark, pdf: pd.DataFrame):
    kinds = {"float64": "double", "bool": "boolean"}
    schema = ", ".join(f"{c} {kinds[str(t)]}" for c, t in pdf.dtypes.items())
    rows = [tuple(None if isinstance(v, float) and v != v else (bool(v) if isinstance(v, (bool, np.bool_)) else float(v)) for v in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 400
    a = rng.normal(10, 2, n)
    b = 3 * a + rng.normal(0, 4, n)
    c = np.exp(a / 2).round(1)
    d = rng.integers(0, 5, n).astype(float)
    return pd.DataFrame({"a": a, "b": b, "c": c, "d": d})


@pytest.mark.parametrize("broadcast", [10**6, 1])
def test_spearman_with_missing_values(spark, data, monkeypatch, broadcast):
    monkeypatch.setattr(R, "BROADCAST_VALUES", broadcast)
    monkeypatch.setattr(R, "HEAVY_SHARE", 20)
    rng = np.random.default_rng(4)
    pdf = data.copy()
    pdf.loc[rng.random(len(pdf)) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(len(pdf)) < 0.4, "d"] = np.nan
    pdf.loc[rng.random(len(pdf)) < 0.5, "c"] = 7.0  # one value holds half of the rows
    df = frame(spark, pdf)
    kinds = K.kinds_from_schema(df)
    for method, pairs in (("pearson", R.pearson_pairs(df, kinds)), ("spearman", R.spearman_pairs(df, kinds))):
        names = list(pdf.columns)
        for r in pairs.collect():
            both = pdf[[names[r["i"]], names[r["j"]]]].dropna()
            ranks = both if method == "pearson" else both.rank()
            assert r["n"] == len(both)
            assert r["r"] == pytest.approx(np.corrcoef(ranks.to_numpy().T)[0, 1], rel=1e-9)


def test_one_scan_for_any_number_of_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 40)) * 10.0 ** rng.integers(-1, 6, 40) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 3.3
    df = frame(spark, pd.DataFrame(x, columns=[f"v{i}" for i in range(40)])).repartition(5)
    started = time.perf_counter()
    pairs = R.pearson_pairs(df, K.kinds_from_schema(df))
    assert time.perf_counter() - started < 20
    for r in pairs.collect():
        both = ~np.isnan(x[:, r["i"]]) & ~np.isnan(x[:, r["j"]])
        assert r["n"] == both.sum()
        if 5 in (r["i"], r["j"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(x[both][:, [r["i"], r["j"]]].T)[0, 1], abs=1e-7)
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    M.pair_moments(df.mapInArrow(seen, df.schema))
    assert rows.value == 300


def test_moments_merge_as_one_set():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) + 1e5
    x[rng.random(x.shape) < 0.3] = np.nan
    whole, a, b = M.matrix_moments(x), np.array([0, 0, 2]), np.array([1, 3, 3])
    parts = M.Moments.empty(4, 4)
    for rows in np.split(x, [0, 7, 8, 300]):
        parts = parts.merged(M.Moments.unpacked(M.matrix_moments(rows).packed(), 4, 4))
    for got in (parts.correlation(3)[a, b], M.list_moments(x, a, b).correlation(3)):
        assert got == pytest.approx(whole.correlation(3)[a, b], abs=1e-9)


def test_ranks_meet_cells_in_one_join(spark, data):
    df = frame(spark, data)
    plans = []
    kept = R.merged_over
    try:
        R.merged_over = lambda d, *a: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), kept(d, *a))[1]
        R.spearman_pairs(df, K.kinds_from_schema(df))
    finally:
        R.merged_over = kept
    assert len(plans) == 1 and plans[0].count("Join ") == 1


def test_undefined_pairs(spark):
    df = frame(spark, pd.DataFrame({"k": [1.0] * 5, "x": [1.0, 2, 3, 4, 5], "few": [1.0, 2.0, np.nan, np.nan, np.nan]}))
    kinds = K.kinds_from_schema(df)
    assert all(r["r"] is None for r in R.pearson_pairs(df, kinds).where("i = 0 or j = 2").collect())
    a, b = R.with_p_values(R.pearson_pairs(df, kinds)), R.with_p_values(R.spearman_pairs(df, kinds))
    assert R.pair_records(a, b, kinds).count() == 0


def test_pair_p_values(spark):
    pairs = spark.createDataFrame([(0, 1, 0.5, 27), (0, 2, 1.0, 9), (1, 2, None, 9)], R.PAIR_SCHEMA)
    p = {(r["i"], r["j"]): r["p"] for r in R.with_p_values(pairs).collect()}
    # r = 0.5, n = 27: t = 2.8868 on 25 dof, p = 0.0079
    assert p[0, 1] == pytest.approx(0.00791, abs=2e-5) and p[0, 2] == 0.0 and p[1, 2] is None


def test_linear_models_against_numpy(spark, data):
    df = frame(spark, data)
    models, terms = R.linear_models(df, K.kinds_from_schema(df))
    for m in models.collect():
        features = [c for c in data if c != m["target"]]
        x = np.column_stack([np.ones(len(data)), data[features]])
        y = data[m["target"]].to_numpy()
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = float(((y - x @ beta) ** 2).sum())
        dof = len(y) - x.shape[1]
        se = np.sqrt(rss / dof * np.diag(np.linalg.inv(x.T @ x)))
        assert m["r_squared"] == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), rel=1e-8)
        vif = np.diag(np.linalg.inv(np.corrcoef(data[features].to_numpy().T)))
        rows = {r["feature"]: r for r in terms.where(F.col("target") == m["target"]).collect()}
        for i, f in enumerate(features):
            assert rows[f]["estimate"] == pytest.approx(beta[i + 1], rel=1e-6)
            assert rows[f]["standard_error"] == pytest.approx(se[i + 1], rel=1e-6)
            assert rows[f]["vif"] == pytest.approx(vif[i], rel=1e-8) and vif[i] >= 1
        order = [abs(r["standardized_estimate"]) for r in sorted(rows.values(), key=lambda r: r["rank"])]
        assert order == sorted(order, reverse=True)


def test_linear_gates(spark, data):
    small = frame(spark, data.head(12))
    reasons = [r["skipped_reason"] for r in R.linear_models(small, K.kinds_from_schema(small))[0].collect()]
    assert all("20 rows" in r for r in reasons)
    exact = data.assign(s=data.a + data.b)[["a", "b", "s", "d"]]
    df = frame(spark, exact)
    found = {r["target"]: r["skipped_reason"] for r in R.linear_models(df, K.kinds_from_schema(df))[0].collect()}
    assert found["d"] == R.COLLINEAR_OLS and found["a"] is None
    flat = pd.DataFrame({"x": np.arange(30.0), "k": [2.0] * 30})
    df = frame(spark, flat)
    found = {r["target"]: r for r in R.linear_models(df, K.kinds_from_schema(df))[0].collect()}
    assert found["x"]["skipped_reason"] == R.ALL_CONSTANT and found["k"]["r_squared"] == 0.0


def irls(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        beta = beta + np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ ((p * (1 - p))[:, None] * x)))), p


def test_logistic_against_own_newton(spark, data):
    rng = np.random.default_rng(9)
    pdf = data[["a", "d"]].copy()
    pdf["won"] = rng.random(len(pdf)) < 1 / (1 + np.exp(-(0.6 * (pdf.a - 10) + 0.3 * (pdf.d - 2))))
    df = frame(spark, pdf)
    models, terms = R.logistic_models(df, K.kinds_from_schema(df))
    x = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.d])
    y = pdf.won.to_numpy().astype(float)
    beta, se, p = irls(x, y)
    m, rows = models.first(), {r["feature"]: r for r in terms.collect()}
    for i, f in enumerate(["a", "d"], 1):
        assert rows[f]["estimate"] == pytest.approx(beta[i], rel=1e-5)
        assert rows[f]["standard_error"] == pytest.approx(se[i], rel=1e-5)
        assert rows[f]["odds_ratio"] == pytest.approx(math.exp(beta[i]), rel=1e-5)
        assert rows[f]["p_value"] == pytest.approx(math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)), rel=1e-3, abs=1e-12)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert m["auc"] == pytest.approx(auc, abs=1e-9)
    assert m["accuracy"] == pytest.approx(((p >= 0.5) == (y == 1)).mean())
    assert m["intercept"] == pytest.approx(beta[0], rel=1e-4)


def test_logistic_targets_with_gaps_are_fitted_together(spark, data):
    rng = np.random.default_rng(12)
    pdf = data[["a", "d"]].copy()
    pdf.loc[rng.random(len(pdf)) < 0.1, "d"] = np.nan
    labels = {f"y{t}": [None if rng.random() < 0.2 * t else bool(rng.random() < 1 / (1 + np.exp(-(t * 0.4 - 0.5) * (a - 10)))) for a in pdf.a] for t in range(3)}
    rows = [(float(a), None if d != d else float(d), *ys) for a, d, *ys in zip(pdf.a, pdf.d, *labels.values())]
    df = spark.createDataFrame(rows, "a double, d double, y0 boolean, y1 boolean, y2 boolean").repartition(3)
    models, terms = R.logistic_models(df, K.kinds_from_schema(df))
    found = {r["target"]: r for r in models.collect()}
    for t in range(3):
        keep = [i for i, r in enumerate(rows) if r[1] is not None and r[2 + t] is not None]
        x = np.array([[1.0, rows[i][0], rows[i][1]] for i in keep])
        beta, se, _ = irls(x, np.array([float(rows[i][2 + t]) for i in keep]))
        own = {r["feature"]: r for r in terms.where(F.col("target") == f"y{t}").collect()}
        assert found[f"y{t}"]["n_observations"] == len(keep) and found[f"y{t}"]["converged"] and found[f"y{t}"]["rounds"] < 12
        for i, f in enumerate(["a", "d"], 1):
            assert own[f]["estimate"] == pytest.approx(beta[i], rel=1e-6) and own[f]["standard_error"] == pytest.approx(se[i], rel=1e-6)


def test_only_unsolvable_equations_are_skipped():
    def broken():
        raise RuntimeError("executor lost")

    def singular():
        raise np.linalg.LinAlgError("singular")

    with pytest.raises(RuntimeError):
        R._isolated(broken, "y", "linear")
    assert R._isolated(singular, "y", "linear")[0][11] == "singular"


def test_logistic_gates_and_separation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    df = frame(spark, pd.DataFrame({"x": x, "z": rng.normal(size=60), "sep": x > 0, "rare": np.arange(60) < 3}))
    models, _ = R.logistic_models(df, K.kinds_from_schema(df))
    found = {r["target"]: r for r in models.collect()}
    assert "only 3 cases" in found["rare"]["skipped_reason"]
    assert found["sep"]["skipped_reason"] is None and found["sep"]["auc"] >= 0.999


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(0.4, True), (0.4, False), (0.4, True)], "s double, y boolean")
    assert R.auc_and_accuracy(df, F.col("s"), F.col("y")).first()["auc"] == 0.5
    one = spark.createDataFrame([(0.4, True)], "s double, y boolean")
    assert R.auc_and_accuracy(one, F.col("s"), F.col("y")).first()["auc"] == 0.5


def test_shown_hints_leave_the_other_groups(spark):
    rows = [(0, 1, "a", "b", 0.3, 0.9, 0.0, True), (0, 2, "a", "c", 0.5, 0.5, 0.0, False), (1, 2, "b", "c", -0.4, -0.4, 0.0, False),
            (0, 3, "a", "d", 0.1, 0.1, 0.5, False)]
    records = spark.createDataFrame(rows, "i int, j int, column_a string, column_b string, pearson double, spearman double, p_value double, non_linear_hint boolean")
    got = {(r["bucket"], r["rank"], r["column_b"]) for r in R.top_pairs(records).collect()}
    assert got == {("non_linear", 1, "b"), ("positive", 1, "c"), ("negative", 1, "c")}


@pytest.mark.parametrize("limit, shuffled", [(500_000, []), (2 + 7, ["wide"]), (0, ["few", "flag", "wide"])])
def test_only_cells_of_wide_columns_are_shuffled(spark, monkeypatch, limit, shuffled):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"few": rng.integers(0, 7, 400).astype(float), "wide": np.round(rng.normal(size=400), 2), "flag": rng.integers(0, 2, 400).astype(float)})
    data["wide"] += data["few"]
    df = frame(spark, data)
    kinds = K.kinds_from_schema(df)
    plans, kept = [], R.merged_over
    monkeypatch.setattr(R, "BROADCAST_VALUES", limit)
    monkeypatch.setattr(R, "merged_over", lambda d, *a: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), kept(d, *a))[1])
    got = {(r["i"], r["j"]): (r["r"], r["n"]) for r in R.spearman_pairs(df, kinds).collect()}
    want = data.corr("spearman").to_numpy()
    assert got == {(i, j): (pytest.approx(want[i, j], abs=1e-12), 400) for i, j in R.column_pairs(3)}
    # rows go back to their places only where several columns were shuffled to their ranks
    assert plans[0].count("RepartitionByExpression [row") == (len(shuffled) > 1)


@pytest.mark.parametrize("limit", [0, 9, 500_000])
def test_wide_columns_with_gaps(spark, monkeypatch, limit):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 4, 300).astype(float), "c": rng.normal(size=300), "none": np.nan})
    for c in ("a", "b", "c"):
        data.loc[rng.random(300) < 0.3, c] = np.nan
    data.loc[:5] = np.nan
    df = frame(spark, data)
    monkeypatch.setattr(R, "BROADCAST_VALUES", limit)
    monkeypatch.setattr(R, "HEAVY_SHARE", 20)
    got = {(r["i"], r["j"]): (r["r"], r["n"]) for r in R.spearman_pairs(df, K.kinds_from_schema(df)).collect()}
    for i, j in R.column_pairs(3):
        both = data.iloc[:, [i, j]].dropna()
        assert got[i, j] == (pytest.approx(both.corr("spearman").iloc[0, 1], abs=1e-12), len(both))
    assert got[0, 3] == (None, 0)
