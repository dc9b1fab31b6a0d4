"""Named queries over the driver's tables, one per operator of the engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.functions import cells, text
from colsight.operators import findings, kinds as K, profile as P, ranking, relate as R, segment as S, trend as T
from colsight.plans import charts
from colsight.plans.analyze import analyze
from colsight.sources import delimited, report

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMERIC_OUT = [
    "name", "total_rows", "missing", "missing_pct", "count", "mean", "std", "cv", "median", "mad", "iqr", "min", "max",
    "p1", "p5", "p25", "p50", "p75", "p95", "p99", "skew", "kurtosis_excess", "outlier_iqr_count",
    "outlier_robust_count", "gini", "zeros_count", "format_hint",
]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded (and without negative zero), so engines compare by value."""
    return df.select(*[
        (F.round(K.name_column(f.name), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() == "double" else K.name_column(f.name)
        for f in df.schema.fields
    ])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[
        K.name_column(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() == "int" else K.name_column(f.name)
        for f in df.schema.fields
    ])


def out(df: DataFrame, digits: int = 4) -> DataFrame:
    return longs(rounded(df, digits))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# ----- derived inputs --------------------------------------------------------


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text with missing words, blanks, thousands commas and odd cells."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return load(spark, sf_dir, "orders").select(
        key.alias("k"),
        F.when(key % 17 == 0, "N/A").when(key % 23 == 0, "").otherwise(price.cast("string")).alias("price"),
        F.when(key % 29 == 0, " nan ").when(key % 31 == 0, "1d").when(key % 37 == 0, "+.5")
        .otherwise(F.concat((key % 9).cast("string"), F.lit(","), F.lpad((key % 1000).cast("string"), 3, "0"))).alias("amount"),
        F.when(key % 19 == 0, "--").otherwise(day).alias("day"),
        F.when(key % 13 == 0, "maybe").when(key % 2 == 0, "Yes").otherwise("n").alias("flag"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("#N/A").alias("empty"),
    )


def dirty_kinds() -> list[K.ColumnKind]:
    named = [("price", "numeric"), ("amount", "numeric"), ("day", "datetime"), ("flag", "boolean"),
             ("priority", "categorical"), ("empty", "unknown")]
    return [K.ColumnKind(n, k, i, date_layout="iso_date" if k == "datetime" else None) for i, (n, k) in enumerate(named)]


def related_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem columns with strong, inverse and curved relations."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        q, p, (p * (1 + F.col("l_tax"))).alias("charge"), (F.lit(60.0) - q + F.col("l_discount") * 40).alias("spare"),
        F.pow(q / 10, F.lit(20.0)).alias("steep"),
    )


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of which two have missing values in different rows."""
    line = F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("a"),
        F.when(line != 2, F.col("l_extendedprice")).alias("b"),
        F.when(line != 3, F.col("l_discount") + F.col("l_quantity") / 100).alias("c"),
    )


def by_schema(df: DataFrame) -> list[K.ColumnKind]:
    return K.kinds_from_schema(df)


# ----- profile ---------------------------------------------------------------


def numeric_profile(table: str, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table).select(*columns)
        return out(P.profile_numeric(df, by_schema(df)).summary.select(*NUMERIC_OUT))
    return run


def gini(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select("c_acctbal")
    b = load(spark, sf_dir, "orders").select("o_totalprice")
    return out(P.gini_table(a, by_schema(a)).unionByName(P.gini_table(b, by_schema(b))), 6)


def histogram(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").select("l_extendedprice")
    b = load(spark, sf_dir, "part").select("p_size")
    parts = [P.histograms(d, by_schema(d)) for d in (a, b)]
    return out(parts[0].unionByName(parts[1]))


def histogram_bars(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select("o_totalprice")
    return out(charts.histogram_bars(P.histograms(d, by_schema(d))))


def outliers_top50(spark, sf_dir):
    d = load(spark, sf_dir, "events").select("value")
    return out(P.robust_outliers(d, by_schema(d)))


def normality(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    s = load(spark, sf_dir, "supplier").select("s_acctbal")
    cols = ["name", "count", "normality_test", "normality_statistic", "normality_p"]
    return out(P.profile_numeric(d, by_schema(d)).summary.select(*cols).unionByName(
        P.profile_numeric(s, by_schema(s)).summary.select(*cols)), 6)


def year_hint(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("month_of_year"),
        (F.year("o_orderdate") + F.lit(0.5)).alias("mid_year"), F.year("o_orderdate").alias("ordered"))
    return P.profile_numeric(d, by_schema(d)).summary.select("name", "format_hint")


def profile_categorical(spark, sf_dir):
    parts = []
    for table, columns in (("orders", ["o_orderpriority", "o_orderstatus"]), ("events", ["event_type"]), ("conversations", ["role"])):
        d = load(spark, sf_dir, table).select(*columns)
        counts = P.category_counts(d, by_schema(d))
        parts.append(P.categorical_summary(d, counts, by_schema(d)).drop("position"))
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]), 6)


def top_values(spark, sf_dir):
    parts = []
    for table, columns in (("lineitem", ["l_returnflag"]), ("part", ["p_brand", "p_type"])):
        d = load(spark, sf_dir, table).select(*columns)
        parts.append(P.top_values_table(P.category_counts(d, by_schema(d)), by_schema(d)))
    return out(parts[0].unionByName(parts[1]), 6)


def profile_boolean(spark, sf_dir):
    d = load(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 1, "yes").otherwise("No").alias("quality"),
        F.when(F.col("doc_id") % 11 == 0, "?").otherwise(F.col("toxic").cast("string")).alias("toxic"))
    kinds = [K.ColumnKind("quality", "boolean", 0), K.ColumnKind("toxic", "boolean", 1)]
    return out(P.boolean_summary(d, kinds).drop("position"), 6)


def profile_datetime(spark, sf_dir):
    parts = []
    for table, column in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        d = load(spark, sf_dir, table).select(column)
        parts.append(P.profile_datetime(d, by_schema(d)).drop("position"))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out(both.withColumn("min_date", stamp(F.col("min_date"))).withColumn("max_date", stamp(F.col("max_date"))), 6)


def missing_report(spark, sf_dir):
    d = K.normalize_missing(dirty_orders(spark, sf_dir)).drop("k")
    return out(P.missing_report(P.profile(d, dirty_kinds())).select("name", "position", "missing", "missing_pct"), 6)


def unknown_columns(spark, sf_dir):
    d = K.normalize_missing(dirty_orders(spark, sf_dir)).select("empty", "priority")
    kinds = [K.ColumnKind("empty", "numeric", 0), K.ColumnKind("priority", "boolean", 1)]
    return out(P.profile(d, kinds).unknown.select("name", "total_rows", "missing", "reason"))


def columns_by_kind(spark, sf_dir):
    d = load(spark, sf_dir, "orders")
    return longs(P.columns_by_kind(P.profile(d, by_schema(d))))


# ----- typing ----------------------------------------------------------------


def infer_kinds(spark, sf_dir):
    """Kinds of text columns, one of them with numbers first and words from row 250 on, one with date-times."""
    d = K.normalize_missing(dirty_orders(spark, sf_dir))
    late = F.when(F.col("k") <= 250, F.col("k").cast("string")).otherwise(F.col("priority"))
    moment = F.concat(F.col("day"), F.lit(" 10:"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"))
    text_only = d.withColumns({"late": late, "moment": moment, "k": F.lpad(F.col("k").cast("string"), 12, "0")})
    found = K.infer_kinds_table(text_only, ["k"])
    return longs(found.select("name", "position", "kind", "missing_count",
                              F.array_join("sample_values", "|").alias("sample_values"), "date_layout"))


def normalize_missing(spark, sf_dir):
    d = K.normalize_missing(dirty_orders(spark, sf_dir))
    return d.select("k", "price", "amount", "day", "empty")


def coerce_numeric(spark, sf_dir):
    d = K.apply_kinds(dirty_orders(spark, sf_dir), [K.ColumnKind("k", "numeric"), *dirty_kinds()[:2]])
    return out(d.withColumn("k", F.col("k").cast("bigint")), 2)


def coerce_datetime(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    return d.select("k", stamp(cells.to_timestamp(F.col("day"), d.schema["day"].dataType)).alias("day"))


def coerce_boolean(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    return d.select("k", cells.to_boolean(F.col("flag"), d.schema["flag"].dataType).cast("string").alias("flag"))


def scrub_non_finite(spark, sf_dir):
    price = F.col("o_totalprice")
    d = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 == 0, F.lit(float("inf")))
        .otherwise(price).alias("price"))
    return report.scrub(d)


def preview(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id"), "lang", "text")
    shown = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "lang",
                     F.regexp_replace("text", r"\s+", " ").alias("text"))
    return delimited.preview(shown, ["id"])


def malformed_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    line = F.concat_ws(",", key.cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')),
                       F.when(key % 7 == 0, None).otherwise(F.col("o_orderstatus")),
                       F.when(key % 11 == 0, F.lit("extra")))
    lines = load(spark, sf_dir, "orders").select(line.alias("value"))
    parsed = delimited.parse_lines(lines, ["key", "priority", "status"])
    return parsed.where(F.col(delimited.CORRUPT).isNotNull()).select(F.col(delimited.CORRUPT).alias("line"))


# ----- ranks -----------------------------------------------------------------


def distributed_rank(spark, sf_dir):
    d = load(spark, sf_dir, "orders")
    counts = ranking.count_values(ranking.long_form(d, {0: F.col("o_totalprice")}))
    ranked = ranking.with_rows_before(counts, bucket_values=20_000)
    return ranked.select("value", "cnt", "before", ranking.average_rank().alias("avg_rank"))


def exact_median(spark, sf_dir):
    d = load(spark, sf_dir, "events").select(F.lit(0).alias("pos"), "value", F.lit(1).cast("bigint").alias("cnt"))
    middle = ranking.medians(d)
    return d.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(middle[0]).alias("median"))


# ----- relations -------------------------------------------------------------


def pearson_pairs(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    return out(R.named_pairs(R.pearson_pairs(d, by_schema(d)), by_schema(d)).select("col_i", "col_j", "r", "n"), 6)


def embedding_cells(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


def pearson_embeddings(spark, sf_dir):
    d = embedding_cells(spark, sf_dir)
    return out(R.named_pairs(R.pearson_pairs(d, by_schema(d)), by_schema(d)).select("col_i", "col_j", "r", "n"), 6)


def spearman_pairs(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    return out(R.named_pairs(R.spearman_pairs(d, by_schema(d)), by_schema(d)).select("col_i", "col_j", "r", "n"), 6)


def pairs_with_gaps(spark, sf_dir):
    d = gappy_lineitem(spark, sf_dir)
    named = lambda pairs, m: R.named_pairs(pairs, by_schema(d)).select(F.lit(m).alias("method"), "col_i", "col_j", "r", "n")
    return out(named(R.pearson_pairs(d, by_schema(d)), "pearson").unionByName(
        named(R.spearman_pairs(d, by_schema(d)), "spearman")), 6)


def _records(d: DataFrame) -> DataFrame:
    a = R.with_p_values(R.pearson_pairs(d, by_schema(d)))
    b = R.with_p_values(R.spearman_pairs(d, by_schema(d)))
    return R.pair_records(a, b, by_schema(d))


def pair_records(spark, sf_dir):
    d = related_lineitem(spark, sf_dir)
    return out(_records(d).select("column_a", "column_b", "pearson", "spearman", "non_linear_hint"), 6)


def pair_p_values(spark, sf_dir):
    """Pearson's and Spearman's r with their p-values."""
    d = load(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", (F.col("c_custkey") % 7).alias("week"))
    cols = ["method", "col_i", "col_j", "r", "p", "n"]
    named = lambda pairs, m: R.named_pairs(R.with_p_values(pairs), by_schema(d)).select(F.lit(m).alias("method"), *cols[1:])
    return out(named(R.pearson_pairs(d, by_schema(d)), "pearson").unionByName(named(R.spearman_pairs(d, by_schema(d)), "spearman")), 6)


def top_pairs(spark, sf_dir):
    d = related_lineitem(spark, sf_dir)
    return out(R.top_pairs(_records(d)).select("bucket", "rank", "column_a", "column_b", "pearson", "spearman"), 6)


def correlation_matrix(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    pairs = R.with_p_values(R.pearson_pairs(d, by_schema(d)))
    return charts.matrix_rows(R.correlation_matrix(pairs, by_schema(d)))


def _models(d: DataFrame) -> DataFrame:
    models, terms = R.linear_models(d, by_schema(d))
    return models.drop("kind").join(terms.drop("kind"), "target")


def ols_simple(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select(
        "o_totalprice", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("day"))
    return out(_models(d).select("target", "feature", "n_observations", "estimate", "intercept", "r_squared",
                                 "adjusted_r_squared", "standard_error", "statistic", "standardized_estimate"), 6)


def ols_p_values(spark, sf_dir):
    d = load(spark, sf_dir, "customer").select("c_acctbal", (F.col("c_custkey") % 7).cast("double").alias("week"))
    return out(_models(d).select("target", "feature", "estimate", "standard_error", "statistic", "p_value", "is_significant"), 6)


def ols_full(spark, sf_dir):
    d = related_lineitem(spark, sf_dir).select("l_quantity", "charge", "spare")
    return out(_models(d).select("target", "feature", "rank", "n_observations", "estimate", "intercept", "r_squared",
                                 "standard_error", "standardized_estimate"), 5)


def vif(spark, sf_dir):
    d = related_lineitem(spark, sf_dir).select("l_quantity", "spare", "charge")
    return out(_models(d).select("target", "feature", "vif", (F.col("vif") > R.VIF_HIGH).alias("high")), 5)


def ols_inference(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS)
    return R.linear_models(d, by_schema(d))[1]


def _labelled_documents(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id").withColumn("n_lines", F.size(F.split("text", "\n")))
    return joined.select("n_chars", "n_lines", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


def logistic(spark, sf_dir):
    d = _labelled_documents(spark, sf_dir)
    models, terms = R.logistic_models(d, by_schema(d))
    return models.select("target", "n_observations", "auc", "accuracy", "true_count", "false_count", "skipped_reason").join(
        terms.select("target", "rank", "feature", "estimate", "odds_ratio", "standard_error", "statistic", "p_value"), "target", "left")


def logistic_lineitem(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS, (F.col("l_returnflag") == "R").alias("returned"))
    return R.logistic_models(d, by_schema(d))[1]


def logistic_groups(spark, sf_dir):
    """Two outcomes against one feature of 0 and 1, fitted together: the odds of the four-fold tables."""
    d = load(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") > 25).cast("double").alias("big"), (F.col("l_returnflag") == "R").alias("returned"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount") > 0.05).alias("cheap"))
    models, terms = R.logistic_models(d, by_schema(d))
    return out(models.select("target", "n_observations", "true_count", "intercept", "auc", "accuracy", "converged").join(
        terms.select("target", "feature", "estimate", "standard_error", "statistic", "p_value", "odds_ratio"), "target"), 5)


def auc_accuracy(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem")
    return out(R.auc_and_accuracy(d, F.col("l_extendedprice") / 110000.0, F.col("l_returnflag") == "R"), 6)


# ----- segments --------------------------------------------------------------


def zscore(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return out(S.zscores(d, [k for k in by_schema(d) if k.name != "p_partkey"], ["p_partkey"]), 6)


def _part_numbers(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_size", "p_retailprice")


def kmeans(spark, sf_dir):
    d = _part_numbers(spark, sf_dir)
    s = S.segment(d, by_schema(d))
    return s.clusters.join(s.features, "cluster")


def k_candidates(spark, sf_dir):
    d = load(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey")
    return S.segment(d, by_schema(d)).candidates


def k_choice(spark, sf_dir):
    """The number of groups of customers that lie in three, and how far these are apart."""
    group = F.col("c_nationkey") % 3
    d = load(spark, sf_dir, "customer").select(
        (group * 100 + F.col("c_acctbal") / 2000).alias("x"), (F.when(group == 1, 80.0).otherwise(0.0) + F.col("c_custkey") % 7).alias("y"))
    return out(S.segment(d, by_schema(d)).summary.select("k", "silhouette", "metric", "n_rows", "converged"), 6)


def projection(spark, sf_dir):
    """Every part on the two directions that vary most, without their signs, which are free."""
    d = load(spark, sf_dir, "part")
    names = ["p_size", "p_retailprice"]
    rows = d.select("p_partkey", *[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)]).na.drop()
    scaling = S.fit_scaling(rows.select("c0", "c1"), names)
    points = rows.select("p_partkey", *S.scaled_cells(scaling))
    axes, _ = S.fit_projection(S.VectorAssembler(inputCols=["z0", "z1"], outputCol="features").transform(points))
    return out(S.projected(points, axes).select("p_partkey", F.abs("x").alias("x"), F.abs("y").alias("y")), 6)


def projection_cells(spark, sf_dir):
    """Rows of given groups in each cell of a grid."""
    d = load(spark, sf_dir, "part").select(
        F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), (F.col("p_partkey") % 3).cast("int").alias("cluster"))
    return out(charts.cluster_points(S.projection_cells(d)))


def pca_variance(spark, sf_dir):
    d = _part_numbers(spark, sf_dir)
    rows = S.complete_rows(d, by_schema(d))
    points = S.VectorAssembler(inputCols=["z0", "z1"], outputCol="features").transform(
        rows.select(*S.scaled_cells(S.fit_scaling(rows, ["p_size", "p_retailprice"]))))
    _, shares = S.fit_projection(points)
    return out(rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(shares[0]).alias("first"), F.lit(shares[1]).alias("second"), F.lit(sum(shares)).alias("total")), 6)


def silhouette_squared_given(spark, sf_dir):
    d = load(spark, sf_dir, "supplier").select("s_acctbal", F.col("s_nationkey").cast("double").alias("nation"),
                                               (F.col("s_nationkey") % 3).alias("cluster"))
    points = S.VectorAssembler(inputCols=["s_acctbal", "nation"], outputCol="features").transform(d)
    score = S.silhouette_squared(points, "cluster")
    return out(d.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(score).alias("silhouette")), 6)


def cluster_summary(spark, sf_dir):
    d = load(spark, sf_dir, "part").withColumn("cluster", (F.col("p_size") % 3).cast("int"))
    sizes = S.cluster_sizes(d)
    shown = S.distinguishing_features(d, {"p_size": "p_size", "p_retailprice": "p_retailprice"})
    return out(sizes.join(shown, "cluster"), 6)


# ----- trends ----------------------------------------------------------------


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("ts", "value")


def trend_fit(spark, sf_dir):
    d = _events(spark, sf_dir)
    t = T.fit_trends(d, by_schema(d))
    return out(t.withColumn("first_at", stamp(F.col("first_at"))).withColumn("last_at", stamp(F.col("last_at"))), 5)


def forecast(spark, sf_dir):
    d = _events(spark, sf_dir)
    f = T.forecast(T.fit_trends(d, by_schema(d)))
    return out(f.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")), 4)


def trend_anchors(spark, sf_dir):
    d = _events(spark, sf_dir)
    a = T.trend_anchors(T.fit_trends(d, by_schema(d)))
    return out(a.withColumn("at", stamp(F.col("at"))), 4)


def trend_history(spark, sf_dir):
    d = _events(spark, sf_dir)
    h = T.history(d, by_schema(d), T.fit_trends(d, by_schema(d)))
    return h.withColumn("at", stamp(F.col("at")))


def series_gate(spark, sf_dir):
    parts = []
    for table, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        d = load(spark, sf_dir, table).select(column)
        parts.append(T.series_gate(d, by_schema(d)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ----- findings --------------------------------------------------------------


def findings_numeric(spark, sf_dir):
    parts = []
    for table, columns in (("lineitem", LINEITEM_NUMBERS), ("events", ["value"]), ("customer", ["c_acctbal"])):
        d = load(spark, sf_dir, table).select(*columns)
        parts.append(findings.numeric_findings(P.profile_numeric(d, by_schema(d)).summary))
    return longs(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("subject", "position", "rule", "severity"))


def findings_categorical(spark, sf_dir):
    d = load(spark, sf_dir, "part").select("p_name", "p_brand", F.when(F.col("p_size") > 5, "big").otherwise("small").alias("bulk"))
    kinds = by_schema(d)
    counts = P.category_counts(d, kinds)
    found = findings.categorical_findings(P.categorical_summary(d, counts, kinds), P.top_values_table(counts, kinds))
    return longs(found.select("subject", "position", "rule", "severity"))


def tied_leaders(spark, sf_dir):
    """How many values lead together, more of them than are shown."""
    d = load(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 8).cast("string").alias("shift"), F.when(F.col("o_orderkey") % 8 < 2, "a").otherwise("b").alias("half"), "o_orderpriority")
    kinds = by_schema(d)
    counts = P.category_counts(d, kinds)
    summary = P.categorical_summary(d, counts, kinds)
    found = findings.categorical_findings(summary, P.top_values_table(counts, kinds)).where("position = 0")
    return out(summary.select("name", "unique_count", "mode_frequency", "tied_count").join(found.select(F.col("subject").alias("name"), "rule"), "name"))


def findings_pairs(spark, sf_dir):
    return longs(findings.pair_findings(_records(related_lineitem(spark, sf_dir))).select("subject", "rule", "severity"))


def findings_models(spark, sf_dir):
    d = related_lineitem(spark, sf_dir).select("l_quantity", "charge", "spare")
    models, terms = R.linear_models(d, by_schema(d))
    return longs(findings.linear_findings(models, terms).select("subject", "position", "rule", "severity"))


def findings_trend(spark, sf_dir):
    d = _events(spark, sf_dir)
    t = T.fit_trends(d, by_schema(d))
    return longs(findings.trend_findings(t, T.forecast(t)).select("subject", "position", "rule", "severity"))


def findings_booleans(spark, sf_dir):
    d = load(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    b = findings.boolean_findings(P.boolean_summary(d, by_schema(d)))
    e = load(spark, sf_dir, "orders").select("o_orderdate")
    t = findings.datetime_findings(P.profile_datetime(e, by_schema(e)))
    return longs(b.unionByName(t).select("subject", "position", "rule", "severity"))


def cell_formats(spark, sf_dir):
    price = F.col("o_totalprice") * F.lit(1.0000037)
    d = load(spark, sf_dir, "orders")
    return d.select(
        "o_orderkey", text.compact_number(price).alias("number"), text.compact_number(price / 1e7).alias("small"),
        text.percent(price / 1e6).alias("share"), text.p_value_text(price / 1e7).alias("p"),
        text.count_text(F.col("o_orderkey")).alias("n"), text.short_date(F.col("o_orderdate")).alias("day"),
        text.file_size(price).alias("bytes"))


def analysis_report(spark, sf_dir):
    """All bounded results of an analysis as rows."""
    return report.long_rows(analyze(_labelled_documents(spark, sf_dir)).parts)


def read_files(spark, sf_dir):
    """Orders written as delimited files with two headers, quoted line breaks and quotes, and read again."""
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    note = F.concat(F.col("o_orderpriority"), F.when(key % 5 == 0, F.lit("\nnext, line")).when(key % 7 == 0, F.lit(' said "so"')).otherwise(""))
    d = load(spark, sf_dir, "orders").select(key.cast("string").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), note.alias("note"))
    options = {"header": True, "escape": '"', "quoteAll": True}
    d.where(key % 2 == 0).write.options(**options).csv(f"{folder}/a")
    d.where(key % 2 == 1).select("note", "id", F.lit("x").alias("more"), "price").write.options(**options).csv(f"{folder}/b")
    found = delimited.read_delimited(spark, folder)
    return found.rows.select("id", "price", "note", "more")


def _scratch(spark: SparkSession) -> str:
    """The folder that all executors share, or one of our own in a local session."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="colsight-")


QUERIES: dict[str, Query] = {
    "profile_numeric_orders": numeric_profile("orders", ["o_totalprice"]),
    "profile_numeric_lineitem": numeric_profile("lineitem", LINEITEM_NUMBERS),
    "profile_numeric_customer": numeric_profile("customer", ["c_acctbal"]),
    "profile_numeric_documents": numeric_profile("documents", ["n_chars"]),
    "gini": gini,
    "histogram": histogram,
    "histogram_bars": histogram_bars,
    "outliers_top50": outliers_top50,
    "normality": normality,
    "year_hint": year_hint,
    "profile_categorical": profile_categorical,
    "top_values": top_values,
    "profile_boolean": profile_boolean,
    "profile_datetime": profile_datetime,
    "missing_report": missing_report,
    "unknown_columns": unknown_columns,
    "columns_by_kind": columns_by_kind,
    "infer_kinds": infer_kinds,
    "normalize_missing": normalize_missing,
    "coerce_numeric": coerce_numeric,
    "coerce_datetime": coerce_datetime,
    "coerce_boolean": coerce_boolean,
    "scrub_non_finite": scrub_non_finite,
    "preview": preview,
    "malformed_rows": malformed_rows,
    "read_files": read_files,
    "distributed_rank": distributed_rank,
    "exact_median": exact_median,
    "pearson_pairs": pearson_pairs,
    "pearson_embeddings": pearson_embeddings,
    "spearman_pairs": spearman_pairs,
    "pairs_with_gaps": pairs_with_gaps,
    "pair_records": pair_records,
    "pair_p_values": pair_p_values,
    "top_pairs": top_pairs,
    "correlation_matrix": correlation_matrix,
    "ols_simple": ols_simple,
    "ols_full": ols_full,
    "ols_p_values": ols_p_values,
    "vif": vif,
    "ols_inference": ols_inference,
    "logistic": logistic,
    "logistic_lineitem": logistic_lineitem,
    "logistic_groups": logistic_groups,
    "auc_accuracy": auc_accuracy,
    "zscore": zscore,
    "kmeans": kmeans,
    "k_candidates": k_candidates,
    "k_choice": k_choice,
    "projection": projection,
    "projection_cells": projection_cells,
    "pca_variance": pca_variance,
    "silhouette_squared_given": silhouette_squared_given,
    "cluster_summary": cluster_summary,
    "trend_fit": trend_fit,
    "forecast": forecast,
    "trend_anchors": trend_anchors,
    "trend_history": trend_history,
    "series_gate": series_gate,
    "findings_numeric": findings_numeric,
    "findings_categorical": findings_categorical,
    "tied_leaders": tied_leaders,
    "findings_pairs": findings_pairs,
    "findings_models": findings_models,
    "findings_trend": findings_trend,
    "findings_booleans": findings_booleans,
    "cell_formats": cell_formats,
    "analysis_report": analysis_report,
}
