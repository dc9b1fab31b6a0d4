import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsight.operators import clustering as C, kinds as K, segment as S, trend as T
from colsight.plans import charts


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0, 5], [9, 1, 5], [4, 9, 5]])
    sizes = [60, 45, 30]
    rows = [(*map(float, c + rng.normal(0, 0.6, 3)), g) for g, (c, n) in enumerate(zip(centres, sizes)) for _ in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, g int").repartition(5)


def test_blobs_are_recovered(spark, blobs):
    df = blobs.drop("g")
    s = S.segment(df, K.kinds_from_schema(df))
    head = s.summary.first()
    assert head["k"] == 3 and head["metric"] == "centroid" and head["converged"] and head["skipped_reason"] is None
    assert S.segment(df, K.kinds_from_schema(df), "euclidean").summary.first()["k"] == 3
    sizes = [r["size"] for r in s.clusters.orderBy("cluster").collect()]
    assert sizes == [60, 45, 30]
    assert [r["label"] for r in s.clusters.orderBy("cluster").collect()] == ["Group A", "Group B", "Group C"]
    assert s.features.count() == 9 and s.projection.count() == 135
    assert charts.projection_variance(s.summary).first()[0] == pytest.approx(head["pca_variance_1"] + head["pca_variance_2"])
    points = charts.cluster_points(s.cells).collect()
    assert {r["cluster"] for r in points} == {0, 1, 2} and sum(r["n"] for r in points) == 135
    again = S.segment(df.repartition(2), K.kinds_from_schema(df)).clusters.orderBy("cluster").collect()
    assert [r["size"] for r in again] == sizes


def test_silhouette_against_definition(spark, blobs):
    points = blobs.select("a", "b", F.col("g").alias("cluster"))
    got = S.silhouette_euclidean(points, ["a", "b"], ["cluster"])["cluster"]
    pdf = points.toPandas()
    x, g = pdf[["a", "b"]].to_numpy(), pdf["cluster"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    values = []
    for i in range(len(x)):
        own = (g == g[i]) & (np.arange(len(x)) != i)
        a = d[i, own].mean()
        b = min(d[i, g == o].mean() for o in set(g) - {g[i]})
        values.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(values), rel=1e-9)


def test_squared_silhouette_against_definition(spark, blobs):
    points = S.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(blobs.withColumn("cluster", F.col("g")))
    pdf = blobs.toPandas()
    x, g = pdf[["a", "b"]].to_numpy(), pdf["g"].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    values = []
    for i in range(len(x)):
        a = d[i, (g == g[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i, g == o].mean() for o in set(g) - {g[i]})
        values.append((b - a) / max(a, b))
    assert S.silhouette_squared(points, "cluster") == pytest.approx(np.mean(values), rel=1e-9)


def test_projection_against_eigenvectors(spark, blobs):
    rows = S.complete_rows(blobs.drop("g"), K.kinds_from_schema(blobs.drop("g")))
    scaling = S.fit_scaling(rows, ["a", "b", "c"])
    points = S.VectorAssembler(inputCols=["z0", "z1", "z2"], outputCol="features").transform(rows.select(*S.scaled_cells(scaling)))
    axes, shares = S.fit_projection(points)
    corr = np.corrcoef(rows.toPandas().to_numpy().T)
    values, vectors = np.linalg.eigh(corr)
    assert shares == pytest.approx(list(values[::-1][:2] / values.sum()), rel=1e-9)
    for k in range(2):
        v = vectors[:, ::-1][:, k]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert axes[:, k] == pytest.approx(v, abs=1e-8)


def test_repeated_points_at_any_size(spark):
    """Six equal points, many times over: six groups, and every row is in the projection."""
    spots = [(0.0, 0.0), (0.0, 9.0), (9.0, 0.0), (9.0, 9.0), (0.0, 30.0), (30.0, 0.0)]
    for rows in (3_996, 4_002):
        at = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spots])
        df = spark.range(rows).select(F.get(at, (F.col("id") % 6).cast("int")).alias("p")).select("p.*")
        got = S.segment(df, K.kinds_from_schema(df))
        assert got.summary.first()["k"] == 6
        assert got.projection.count() == rows and got.projection.select(F.round("x", 6), F.round("y", 6)).distinct().count() == 6


def test_same_choice_on_both_sides_of_the_old_limit(spark):
    spot = lambda *at: F.get(F.array(*[F.lit(float(v)) for v in at]), (F.col("id") % 3).cast("int"))
    for rows in (3_999, 4_001):
        df = spark.range(rows).select((spot(0, 9, 3) + F.rand(1)).alias("a"), (spot(0, 1, 9) + F.rand(2)).alias("b"))
        head = S.segment(df, K.kinds_from_schema(df)).summary.first()
        assert (head["k"], head["metric"], head["n_rows"]) == (3, "centroid", rows)
        assert S.segment(df, K.kinds_from_schema(df), "squared_euclidean").summary.first()["metric"] == "squared_euclidean"
    with pytest.raises(ValueError, match="too many rows"):
        S.segment(df, K.kinds_from_schema(df), "euclidean")


def test_all_fits_against_plain_lloyd(spark, blobs):
    columns = ["a", "b"]
    fits = C.fit_groups(blobs, columns, [2, 3, 5], 2, 100, 0.0, 7)
    x = blobs.select(*columns).toPandas().to_numpy()
    for k, fit in fits.items():
        gaps = ((x[:, None] - fit.centers[None]) ** 2).sum(-1)
        own = gaps.argmin(1)
        assert fit.converged and fit.sizes.tolist() == np.bincount(own, minlength=k).tolist()
        assert fit.centers == pytest.approx(np.array([x[own == c].mean(0) for c in range(k)]))
        assert fit.cost == pytest.approx(gaps.min(1).sum())
        two = np.sqrt(np.sort(gaps, axis=1)[:, :2])
        assert fit.separation == pytest.approx(((two[:, 1] - two[:, 0]) / two[:, 1]).mean())
        numbers = blobs.select(*columns, C.nearest(columns, fit.centers).alias("c")).toPandas()["c"].to_numpy()
        assert (numbers == own).all()
    stopped = C.fit_groups(blobs, columns, [5], 1, 1, 0.0, 7)[5]
    assert not stopped.converged and stopped.rounds == 1


def test_segment_gates(spark):
    few = spark.range(10).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("b"))
    assert "at least 20 rows" in S.segment(few, K.kinds_from_schema(few)).summary.first()["skipped_reason"]
    narrow = spark.range(30).select(F.col("id").cast("double").alias("a"))
    assert "2 numeric columns" in S.segment(narrow, K.kinds_from_schema(narrow)).summary.first()["skipped_reason"]
    holes = spark.range(30).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") < 5, 1.0).alias("b"))
    assert "only 5 rows remain" in S.segment(holes, K.kinds_from_schema(holes)).summary.first()["skipped_reason"]


def weekly(spark, n=20, slope=2.0, noise=0.0, gap=7):
    days = pd.date_range("2024-01-01", periods=n, freq=f"{gap}D")
    rng = np.random.default_rng(0)
    rows = [(d.strftime("%Y-%m-%d"), 10 + slope * i + noise * rng.normal()) for i, d in enumerate(days)]
    return spark.createDataFrame(rows[::-1], "d string, v double").select(F.to_date("d").cast("timestamp_ntz").alias("d"), "v")


def test_exact_line(spark):
    df = weekly(spark)
    t = T.trace(df, K.kinds_from_schema(df))
    r = t.trends.first()
    assert r["trend_slope"] == pytest.approx(2 / 7) and r["trend_intercept"] == pytest.approx(10) and r["trend_r_squared"] == pytest.approx(1)
    assert (r["cadence_label"], r["median_gap_days"], r["n_observations"]) == ("weekly", 7.0, 20)
    f = t.forecast.orderBy("step").collect()
    assert len(f) == 5 and str(f[0]["at"]) == "2024-05-20 00:00:00" and f[-1]["value"] == pytest.approx(10 + 2 * 24)
    assert t.skipped_reason is None and t.history.first()["value"] == 10.0
    assert [round(a["value"], 6) for a in t.anchors.orderBy("at").collect()] == [10.0, 48.0]


def test_band_width_is_constant(spark):
    df = weekly(spark, n=60, noise=3.0, gap=1)
    t = T.fit_trends(df, K.kinds_from_schema(df))
    rows = T.forecast(t).collect()
    widths = {round(r["upper_95"] - r["lower_95"], 9) for r in rows}
    pdf = df.toPandas().sort_values("d")
    x = (pdf["d"] - pdf["d"].iloc[0]).dt.total_seconds().to_numpy() / 86400
    b, a = np.polyfit(x, pdf["v"], 1)
    sd = np.sqrt(((pdf["v"] - a - b * x) ** 2).sum() / (len(x) - 2))
    assert len(rows) == 12 and widths == {round(2 * 1.96 * sd, 9)}


def test_series_gates(spark):
    repeated = weekly(spark, n=20).unionByName(weekly(spark, n=20))
    gate = T.series_gate(repeated, K.kinds_from_schema(repeated)).first()
    assert gate["reason"] == "repeated times" and T.trace(repeated, K.kinds_from_schema(repeated)).skipped_reason == T.NO_SERIES
    short = weekly(spark, n=9)
    assert T.series_gate(short, K.kinds_from_schema(short)).first()["reason"] == "too few distinct times"
    flat = weekly(spark, slope=0.0)
    assert T.fit_trends(flat, K.kinds_from_schema(flat)).isEmpty()
    no_dates = flat.select("v")
    assert T.trace(no_dates, K.kinds_from_schema(no_dates)).skipped_reason == T.NO_DATES


def test_gaps_follow_rows_complete_in_both(spark):
    df = weekly(spark, n=40, gap=1).withColumn("thin", F.when(F.dayofmonth("d") % 2 == 0, F.col("v")))
    t = {r["value_column"]: r["median_gap_days"] for r in T.fit_trends(df, K.kinds_from_schema(df)).collect()}
    assert t == {"v": 1.0, "thin": 2.0}


@pytest.mark.parametrize("query", ["clusters", "candidates"])
def test_rounds_use_all_cores_whatever_the_files(spark, monkeypatch, query):
    """The table is one task's; every pass over its points is several tasks', and the passes are those of plain Lloyd."""
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal((9 * i, 9 * i), 0.5, (4_000, 2)) for i in range(3)])
    df = spark.createDataFrame(pd.DataFrame(data, columns=["x", "y"])).coalesce(1)
    tasks, kept = [], S.fit_groups
    monkeypatch.setattr(S, "fit_groups", lambda points, *a: (tasks.append(points.rdd.getNumPartitions()), kept(points, *a))[1])
    got = getattr(S.segment(df, K.kinds_from_schema(df)), query).collect()
    assert tasks == [min(spark.sparkContext.defaultParallelism, 6)]
    if query == "clusters":
        assert [r["size"] for r in got] == [4_000] * 3
    else:
        assert max(got, key=lambda r: r["score"])["k"] == 3 and len(got) == S.K_MAX - S.K_MIN + 1


def test_the_first_of_equally_near_centres_counts(spark):
    points = spark.createDataFrame(pd.DataFrame({"z0": [-1.0, 0.0, 0.0, 1.0], "z1": 0.0}))
    n, total = C._members(points, ["z0", "z1"], [np.array([[-1.0, 0], [1, 0]]), np.array([[1.0, 0], [-1, 0], [9, 9]])])
    assert n.tolist() == [3, 1, 3, 1, 0] and total[:, 0].tolist() == [-1, 1, 1, -1, 0]
