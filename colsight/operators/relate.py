"""Relations between columns: correlations, linear and logistic regressions.

Row data is only touched by aggregates. What reaches the driver is bounded by
the number of columns: pair rows, one cross-product matrix, model rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.special import t_two_sided_p, t_two_sided_p_col
from colsight.functions.tables import small_table
from colsight.operators import ranking
from colsight.operators.kinds import ColumnKind, of_kind, typed_cell
from colsight.operators.moments import Moments, list_moments, matrix_moments, matrix_of, merged_over, pair_moments

# --- fixed values: limits and reasons ----------------------------------------
TOP_PAIRS = 3
MIN_REPORTABLE_R = 0.15
NON_LINEAR_GAP = 0.20
NON_LINEAR_STRENGTH = 0.4
VIF_HIGH = 10.0
ALPHA = 0.05
MIN_PAIR_ROWS = 3
MIN_OLS_ROWS = 20
MIN_LOGISTIC_ROWS = 20
MIN_MINORITY = 5
PROBABILITY_FLOOR = 1e-9
NO_FEATURES = "No feature columns to regress against."
FEW_OLS_ROWS = "Need at least {} rows with valid data; this column has only {}."
ALL_CONSTANT = "All feature columns are constant; no variation to model."
TOO_MANY_FEATURES = "Too many features for the available sample size."
COLLINEAR_OLS = "Feature columns are too collinear to invert. Try removing duplicates."
FEW_LOGISTIC_ROWS = ("Need at least {} rows with valid data; only {} available after dropping rows "
                     "with missing target or feature values.")
SMALL_CLASS = ("The smaller class has only {} cases. Logistic regression needs at least {} of each "
               "outcome to give reliable results.")
COLLINEAR_LOGISTIC = "Feature columns are too collinear to compute reliable standard errors."
# --- end of fixed values -----------------------------------------------------

CONDITION_LIMIT = 1e12
MAX_NEWTON = 30
NEWTON_STEP = 1e-7  # in standard deviations of the features
NEWTON_GAIN = 1e-13
MAX_HALVINGS = 8
# Ranks of columns with up to this many values together (about 16 MB) are broadcast; cells of other columns shuffle.
BROADCAST_VALUES = 500_000
# A value held by more than one row in HEAVY_SHARE is salted; at most HEAVY_SHARE such values exist.
HEAVY_SHARE = 1_000
SALTS = 64

PAIR_SCHEMA = "i int, j int, r double, n bigint"
MODEL_SCHEMA = (
    "target string, kind string, n_observations bigint, r_squared double, adjusted_r_squared double, "
    "intercept double, auc double, accuracy double, true_count bigint, false_count bigint, "
    "multicollinear array<string>, skipped_reason string, converged boolean, rounds int"
)
COEFFICIENT_SCHEMA = (
    "target string, kind string, rank int, feature string, estimate double, standardized_estimate double, "
    "standard_error double, statistic double, p_value double, is_significant boolean, odds_ratio double, vif double"
)


def column_pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def numeric_frame(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """The numeric columns as doubles named c0, c1, ..."""
    return df.select(*[typed_cell(df, k).alias(f"c{i}") for i, k in enumerate(of_kind(kinds, "numeric"))])


# ----- correlations ----------------------------------------------------------


def _pair_rows(spark, pairs: list[tuple[int, int]], r: np.ndarray, n: np.ndarray) -> DataFrame:
    rows = [(i, j, None if math.isnan(x) else float(x), int(m)) for (i, j), x, m in zip(pairs, r, n)]
    return small_table(spark, rows, PAIR_SCHEMA)


def pearson_pairs(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """``(i, j, r, n)`` for every pair of numeric columns, each on its own complete rows; one scan for all pairs."""
    frame = numeric_frame(df, kinds)
    pairs = column_pairs(len(frame.columns))
    if not pairs:
        return small_table(df.sparkSession, [], PAIR_SCHEMA)
    moments = pair_moments(frame)
    a, b = np.array(pairs).T
    return _pair_rows(df.sparkSession, pairs, moments.correlation(MIN_PAIR_ROWS)[a, b], moments.n[a, b])


def attach_ranks(long: DataFrame, ranks: DataFrame, heavy: DataFrame) -> DataFrame:
    """``long`` with ``rank`` in place of ``value``: cells ``(row, pos, value, ...)`` meet ``ranks`` ``(pos, value, rank)``,
    unique by pos and value, by one shuffle. The values of ``heavy`` (a bounded table ``(pos, value)``) and missing ones,
    which have no rank, are spread over SALTS tasks by row."""
    key = ["pos", "value"]
    flag = F.broadcast(heavy.withColumn("hot", F.lit(True)))
    salted = long.join(flag, key, "left").withColumn(
        "salt", F.when(F.col("hot") | F.col("value").isNull(), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = ranks.join(flag, key, "left").withColumn("salt", F.explode(copies))
    return salted.drop("hot").join(spread.drop("hot"), [*key, "salt"], "left").drop("value", "salt")


def _narrow(sizes: dict[int, tuple[int, int]]) -> set[int]:
    """Columns, those with the fewest values first, whose ranks together are few enough for a broadcast."""
    out, total = set(), 0
    for pos, (_, distinct) in sorted(sizes.items(), key=lambda x: (x[1][1], x[0])):
        total += distinct
        if total > BROADCAST_VALUES:
            break
        out.add(pos)
    return out


def _wide_rows(frame: DataFrame, cells: dict[int, Column], wide: list[int], ranks: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(row, pos, value, rank)`` cells, those of a row one after another. Only cells of ``wide`` columns are shuffled, to
    their ranks and back to their rows; the other values of a row travel with the first of them and get no rank here."""
    narrow = [pos for pos in cells if pos not in wide]
    none = F.lit(None).cast("double")
    others = F.array(*[cells[pos] for pos in narrow]).cast("array<double>")
    carried = {pos: {"row": F.col("row"), "others": others if pos == wide[0] else F.lit(None).cast("array<double>")} for pos in wide}
    long = ranking.long_form(frame, {pos: cells[pos] for pos in wide}, carried)
    ranked = attach_ranks(long.where(F.col("value").isNotNull() | F.col("others").isNotNull()), ranks, heavy)
    if len(wide) > 1:
        ranked = ranked.repartition("row").sortWithinPartitions("row")
    own = F.struct("pos", none.alias("value"), F.col("rank").alias("rank"))
    rest = [F.struct(F.lit(pos).alias("pos"), F.get("others", F.lit(k)).alias("value"), none.alias("rank")) for k, pos in enumerate(narrow)]
    return ranked.select("row", F.inline(F.when(F.col("others").isNull(), F.array(own)).otherwise(F.array(own, *rest))))


def _ranked_rows(pairs: list[tuple[int, int]], width: int):
    """Moments of ``(row, pos, rank)`` cells, those of a row one after another: cells become rows of a matrix again."""
    a, b = np.array(pairs).T

    def matrix(row: np.ndarray, cells: np.ndarray) -> np.ndarray:
        at = np.cumsum(np.diff(row, prepend=row[0]) != 0)
        out = np.full((at[-1] + 1, width), np.nan)
        out[at, cells[:, 0].astype(int)] = cells[:, 1]
        return out

    def run(batches):
        row, cells = np.zeros(0, np.int64), np.zeros((0, 2))
        for batch in batches:
            row = np.concatenate((row, batch.column(0).to_numpy()))
            cells = np.concatenate((cells, np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])))
            cut = int(len(row) - np.argmin(np.append(row[::-1] == row[-1], False))) if len(row) else 0  # the last row may go on
            if cut:
                yield list_moments(matrix(row[:cut], cells[:cut]), a, b)
            row, cells = row[cut:], cells[cut:]
        if len(row):
            yield list_moments(matrix(row, cells), a, b)

    return run


def spearman_pairs(df: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """``(i, j, r, n)``: Pearson of average ranks taken within each pair's complete rows.

    A column is ranked once, plus once more for every other column whose missing values drop rows from the pair. All
    columns are ranked together, as cells ``(row, column, value)``. Columns with few values get their ranks from a
    broadcast table, without a shuffle of rows; only the cells of the others are shuffled.
    """
    spark = df.sparkSession
    frame = numeric_frame(df, kinds)
    gaps = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns]).first()
    mask_of = lambda j: j if gaps[f"c{j}"] else None
    pairs, ends, tasks = column_pairs(len(frame.columns)), [], {}
    for i, j in pairs:
        ends.append(tuple(tasks.setdefault(t, len(tasks)) for t in ((i, mask_of(j)), (j, mask_of(i)))))
    if not tasks:
        return small_table(spark, [], PAIR_SCHEMA)

    def task_cell(task: tuple[int, int | None]) -> Column:
        a, b = task
        return F.col(f"c{a}") if b is None else F.when(F.col(f"c{b}").isNotNull(), F.col(f"c{a}"))

    cells = {pos: task_cell(t) for t, pos in tasks.items()}
    counts = ranking.hold(ranking.count_values(ranking.long_form(frame, cells)))
    try:
        sizes = ranking.column_sizes(counts)
        ranked = ranking.with_rows_before(counts, sizes).select("pos", "value", ranking.average_rank().alias("rank"))
        narrow = _narrow(sizes)
        wide = [pos for pos in cells if pos in sizes and pos not in narrow]
        frame = frame.withColumn("row", F.monotonically_increasing_id())
        few = F.broadcast(ranked.where(F.col("pos").isin(*narrow)) if wide else ranked)
        # a broadcast join hands on the cells in the order of their rows, so they need no shuffle
        if wide:
            # at most HEAVY_SHARE values per ranked column
            limit = small_table(spark, [(pos, sizes[pos][0] // HEAVY_SHARE) for pos in wide], "pos int, least bigint")
            heavy = counts.join(F.broadcast(limit), "pos").where(F.col("cnt") > F.col("least")).select("pos", "value")
            by_row = _wide_rows(frame, cells, wide, ranked.where(F.col("pos").isin(*wide)), heavy)
            by_row = by_row.join(few.withColumnRenamed("rank", "few"), ["pos", "value"], "left").select("row", "pos", F.coalesce("rank", "few").alias("rank"))
            by_row = by_row.where(F.col("rank").isNotNull())
        else:
            long = ranking.long_form(frame, cells, {pos: {"row": F.col("row")} for pos in cells})
            by_row = long.where(F.col("value").isNotNull()).join(few, ["pos", "value"]).select("row", "pos", "rank")
        moments = merged_over(by_row, _ranked_rows(ends, len(tasks)), len(pairs))
    finally:
        counts.unpersist()
    return _pair_rows(spark, pairs, moments.correlation(MIN_PAIR_ROWS), moments.n)


def with_p_values(pairs: DataFrame) -> DataFrame:
    """Two-sided p of each r from Student's t with n - 2 degrees of freedom."""
    r, dof = F.col("r"), (F.col("n") - 2).cast("double")
    t = F.abs(r) * F.sqrt(F.try_divide(dof, 1 - r * r))
    return pairs.withColumn("p", F.when(r.isNotNull(), F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided_p_col(t, dof))))


def named_pairs(pairs: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    names = [(i, k.name) for i, k in enumerate(of_kind(kinds, "numeric"))]
    a = small_table(pairs.sparkSession, names, "i int, col_i string")
    b = small_table(pairs.sparkSession, names, "j int, col_j string")
    return pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j")


def correlation_matrix(pairs: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Long square matrix ``(col_i, col_j, r, p, n)``, diagonal r = 1 and p = 0."""
    upper = named_pairs(pairs, kinds).select("i", "j", "col_i", "col_j", "r", "p", "n")
    lower = upper.select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"),
        "r", "p", "n",
    )
    diagonal = small_table(
        pairs.sparkSession,
        [(i, i, k.name, k.name, 1.0, 0.0, None) for i, k in enumerate(of_kind(kinds, "numeric"))],
        "i int, j int, col_i string, col_j string, r double, p double, n bigint",
    )
    return upper.unionByName(lower).unionByName(diagonal)


def pair_records(pearson: DataFrame, spearman: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    """Pairs with both coefficients: the smaller p, and the non-linear hint."""
    a = pearson.where(F.col("r").isNotNull()).select("i", "j", F.col("r").alias("pearson"), F.col("p").alias("p_a"))
    b = spearman.where(F.col("r").isNotNull()).select("i", "j", F.col("r").alias("spearman"), F.col("p").alias("p_b"))
    gap = F.abs(F.col("spearman") - F.col("pearson"))
    strength = F.greatest(F.abs("pearson"), F.abs("spearman"))
    return named_pairs(a.join(b, ["i", "j"]), kinds).select(
        "i", "j", F.col("col_i").alias("column_a"), F.col("col_j").alias("column_b"), "pearson", "spearman",
        F.coalesce(F.least("p_a", "p_b"), F.lit(1.0)).alias("p_value"),
        ((gap >= NON_LINEAR_GAP) & (strength >= NON_LINEAR_STRENGTH)).alias("non_linear_hint"),
    )


def top_pairs(records: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    """The strongest non-linear, positive and negative pairs; shown hints leave the other groups."""
    gap = F.abs(F.col("spearman") - F.col("pearson"))

    def best(rows: DataFrame, bucket: str, order: Column) -> DataFrame:
        ranked = rows.withColumn("bucket", F.lit(bucket)).withColumn(
            "rank", F.row_number().over(Window.partitionBy("bucket").orderBy(order, "i", "j"))
        )
        return ranked.where(F.col("rank") <= limit)

    hints = best(records.where("non_linear_hint"), "non_linear", gap.desc())
    key = [F.least("column_a", "column_b").alias("first"), F.greatest("column_a", "column_b").alias("second")]
    shown = hints.select(*key)
    rest = records.select("*", *key).join(F.broadcast(shown), ["first", "second"], "left_anti").drop("first", "second")
    positive = best(rest.where(F.col("pearson") >= MIN_REPORTABLE_R), "positive", F.col("pearson").desc())
    negative = best(rest.where(F.col("pearson") <= -MIN_REPORTABLE_R), "negative", F.col("pearson").asc())
    return hints.unionByName(positive).unionByName(negative).select(
        "bucket", "rank", "column_a", "column_b", "pearson", "spearman", "p_value", "non_linear_hint"
    )


# ----- shared moments --------------------------------------------------------


@dataclass
class Design:
    """Size, means and centred cross-products of listwise-complete rows."""

    n: int
    means: np.ndarray
    products: np.ndarray

    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.products), 0.0) / max(self.n - 1, 1))


def design_matrix(complete: DataFrame) -> Design:
    """Of all columns of a table of doubles without gaps, in one scan."""
    m = pair_moments(complete)
    return Design(int(m.n[0, 0]) if m.n.size else 0, np.diag(m.mean_a).copy(), m.cross)


def _invert_scaled(products: np.ndarray) -> np.ndarray | None:
    """Inverse of the correlation form of a cross-product matrix; None if near singular."""
    scale = np.sqrt(np.diag(products))
    form = products / np.outer(scale, scale)
    if not np.all(np.isfinite(form)) or np.linalg.cond(form) > CONDITION_LIMIT:
        return None
    return np.linalg.inv(form)


# ----- linear regression -----------------------------------------------------


def solve_linear(moments: Design, names: list[str], target: int) -> tuple[tuple, list[tuple]]:
    """Model row and coefficient rows of one target from the shared moments."""
    name, n = names[target], moments.n

    def skipped(reason: str) -> tuple[tuple, list[tuple]]:
        return _skipped_model(name, "linear", reason), []

    features = [i for i in range(len(names)) if i != target]
    if not features:
        return skipped(NO_FEATURES)
    if n < MIN_OLS_ROWS:
        return skipped(FEW_OLS_ROWS.format(MIN_OLS_ROWS, n))
    active = [i for i in features if moments.products[i, i] > 0]
    if not active:
        return skipped(ALL_CONSTANT)
    dof = n - len(active) - 1
    if dof < 1:
        return skipped(TOO_MANY_FEATURES)
    xx, xy = moments.products[np.ix_(active, active)], moments.products[active, target]
    inverse = _invert_scaled(xx)
    if inverse is None:
        return skipped(COLLINEAR_OLS)
    root = np.sqrt(np.diag(xx))
    beta = inverse @ (xy / root) / root
    tss = float(moments.products[target, target])
    rss = max(tss - float(beta @ xy), 0.0)
    r2 = 1.0 - rss / tss if tss > 0 else 0.0
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / dof
    error = np.sqrt(rss / dof * np.diag(inverse)) / root
    sd = moments.sd()
    standardized = beta * sd[active] / sd[target] if sd[target] > 0 else np.zeros_like(beta)
    vif = np.diag(inverse) if len(active) > 1 else np.full(len(active), np.nan)
    rows = []
    for k, i in enumerate(active):
        t = float(beta[k] / error[k]) if error[k] > 0 else 0.0
        p = t_two_sided_p(t, dof)
        rows.append((names[i], float(beta[k]), float(standardized[k]), float(error[k]), t, p, p < ALPHA, None,
                     float(vif[k]) if math.isfinite(vif[k]) else None))
    overlap = [r[0] for r in rows if r[8] is not None and r[8] > VIF_HIGH]
    intercept = float(moments.means[target] - beta @ moments.means[active])
    model = (name, "linear", n, r2, adjusted, intercept, None, None, None, None, overlap, None, True, 1)
    return model, _ranked_coefficients(name, "linear", rows)


def _ranked_coefficients(target: str, kind: str, rows: list[tuple]) -> list[tuple]:
    """Most influential first: |standardised estimate| descending, then feature name."""
    ordered = sorted(rows, key=lambda r: (-abs(r[2]), r[0]))
    return [(target, kind, rank, *r) for rank, r in enumerate(ordered, 1)]


def linear_models(df: DataFrame, kinds: list[ColumnKind]) -> tuple[DataFrame, DataFrame]:
    """Least squares of every numeric column on all others: (models, coefficients)."""
    spark = df.sparkSession
    frame = numeric_frame(df, kinds).na.drop()
    names = [k.name for k in of_kind(kinds, "numeric")]
    moments = design_matrix(frame)
    models, coefficients = [], []
    for target in range(len(names)):
        model, rows = _isolated(lambda: solve_linear(moments, names, target), names[target], "linear")
        models.append(model)
        coefficients += rows
    return small_table(spark, models, MODEL_SCHEMA), small_table(spark, coefficients, COEFFICIENT_SCHEMA)


def _skipped_model(target: str, kind: str, reason: str) -> tuple:
    if kind == "linear":
        return (target, kind, 0, 0.0, 0.0, None, None, None, None, None, [], reason, None, None)
    return (target, kind, 0, None, None, None, 0.5, 0.0, 0, 0, [], reason, None, None)


def _isolated(run, target: str, kind: str) -> tuple[tuple, list[tuple]]:
    """A model whose equations cannot be solved does not fail the others; any other error rises."""
    try:
        return run()
    except np.linalg.LinAlgError as problem:
        return _skipped_model(target, kind, str(problem)), []


# ----- logistic regression ---------------------------------------------------


def auc_and_accuracy(df: DataFrame, score: Column, label: Column, cut: float = 0.5) -> DataFrame:
    """Exact AUC from average ranks (0.5 when one class is empty) and accuracy at ``cut``."""
    return scores_quality(df, {0: (score, label)}, cut).drop("pos")


def scores_quality(df: DataFrame, scored: dict[int, tuple[Column, Column]], cut: float = 0.5) -> DataFrame:
    """``auc_and_accuracy`` of several (score, label) at once, one row per key ``pos``.

    Rows are collapsed to distinct scores first, so ties of any size cost one row. Rows without a label do not count.
    """
    cells = {pos: F.when(label.isNotNull(), score) for pos, (score, label) in scored.items()}
    long = ranking.long_form(df, cells, {pos: {"hit": label.cast("int")} for pos, (_, label) in scored.items()})
    counts = ranking.hold(ranking.count_values(long, None, hits=F.col("hit")))
    try:
        right = F.sum(F.when(F.col("value") >= cut, F.col("hits")).otherwise(F.col("cnt") - F.col("hits")))
        sums = ranking.with_rows_before(counts).groupBy("pos").agg(
            F.sum("cnt").alias("n"), F.sum("hits").alias("true_count"),
            F.sum(F.col("hits") * ranking.average_rank()).alias("rank_sum"), right.alias("right"),
        )
        found = small_table(df.sparkSession, [(pos,) for pos in scored], "pos int").join(sums, "pos", "left").fillna(0, ["n", "true_count", "right"])
        n, ones = F.col("n").cast("double"), F.col("true_count").cast("double")
        zeros = n - ones
        auc = F.coalesce(F.try_divide(F.col("rank_sum") - ones * (ones + 1) / 2, ones * zeros), F.lit(0.5))
        out = found.select(
            "pos", "n", "true_count", (F.col("n") - F.col("true_count")).alias("false_count"), auc.alias("auc"),
            F.coalesce(F.try_divide(F.col("right").cast("double"), n), F.lit(0.0)).alias("accuracy"),
        )
        return small_table(df.sparkSession, out.collect(), out.schema)  # one row per key
    finally:
        counts.unpersist()


@dataclass
class LogitFit:
    """``beta``: intercept first. ``lost``: the equations became singular; ``rounds``: passes over the rows."""

    beta: np.ndarray
    covariance: np.ndarray | None = None
    converged: bool = False
    lost: bool = False
    rounds: int = 0


def logit_probability(beta: np.ndarray, scale: Design, active: list[int]) -> Column:
    """Fitted probability from the feature columns c0, c1, ..."""
    sd, linear = scale.sd(), F.lit(float(beta[0]))
    for i, b in zip(active, beta[1:]):
        linear = linear + F.lit(float(b)) * ((F.col(f"c{i}") - F.lit(float(scale.means[i]))) / F.lit(float(sd[i])))
    return 1.0 / (1.0 + F.exp(-linear))


def _logit_sums(rows: DataFrame, features: int, trials: dict[int, tuple[np.ndarray, Design, list[int]]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and Fisher information of several models at their trial estimates, in one pass.

    ``rows``: features c0, ... and then labels, null where a row is not the model's. Sums leave a task as numbered cells
    that Spark adds up, so the driver sees (features + 1) squared numbers per model.
    """
    held = {t: (beta, scale.means[active], scale.sd()[active], active) for t, (beta, scale, active) in trials.items()}
    widths = {t: 1 + len(beta) + len(beta) ** 2 for t, (beta, *_) in held.items()}
    begin = dict(zip(widths, np.cumsum([0, *widths.values()]).tolist()))

    def partial(batches):
        total = np.zeros(sum(widths.values()))
        for batch in batches:
            cells = matrix_of(batch)
            for t, (beta, means, sd, active) in held.items():
                label = cells[:, features + t]
                own = ~np.isnan(label)
                x = np.column_stack([np.ones(own.sum()), (cells[own][:, active] - means) / sd])
                y, eta = label[own], np.clip(x @ beta, -700.0, 700.0)
                chance = 1.0 / (1.0 + np.exp(-eta))
                safe = np.clip(chance, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
                part = (
                    [np.log(np.where(y == 1, safe, 1.0 - safe)).sum()], x.T @ (y - chance),
                    ((x * (safe * (1.0 - safe))[:, None]).T @ x).ravel(),
                )
                total[begin[t] : begin[t] + widths[t]] += np.concatenate(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    sums = np.zeros(sum(widths.values()))
    for r in rows.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[r["at"]] = r["value"]
    out = {}
    for t, (beta, *_) in held.items():
        k, part = len(beta), sums[begin[t] : begin[t] + widths[t]]
        out[t] = float(part[0]), part[1 : 1 + k].copy(), part[1 + k :].reshape(k, k)
    return out


def fit_logits(rows: DataFrame, features: int, starts: dict[int, tuple[float, Design, list[int]]]) -> dict[int, LogitFit]:
    """Newton's method for all models side by side: one pass over the rows is one step of each.

    A step that lowers a model's likelihood is halved and tried again with the others' next step. Under separation the
    estimates grow without bound, so a model ends on a flat likelihood or, not ``converged``, at the step limit.
    """
    known = {t: (scale, active) for t, (_, scale, active) in starts.items()}
    fits = {t: LogitFit(np.concatenate(([base], np.zeros(len(active))))) for t, (base, _, active) in starts.items()}
    trial = {t: f.beta for t, f in fits.items()}
    state: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    step: dict[int, np.ndarray] = {}
    halved = dict.fromkeys(fits, 0)
    while trial:
        found = _logit_sums(rows, features, {t: (beta, *known[t]) for t, beta in trial.items()})
        for t in list(trial):
            fit = fits[t]
            fit.rounds += 1
            done = False
            if t in state:
                level, gain = state[t][0], found[t][0] - state[t][0]
                if gain < -1e-12 * abs(level):
                    halved[t] += 1
                    step[t] = step[t] / 2.0
                    done = halved[t] > MAX_HALVINGS
                else:
                    fit.beta, state[t], halved[t] = trial[t], found[t], 0
                    fit.converged = bool(np.max(np.abs(step[t])) < NEWTON_STEP or gain <= NEWTON_GAIN * abs(level))
                    done = fit.converged or fit.rounds > MAX_NEWTON
            else:
                state[t] = found[t]
            try:
                if not done and not halved[t]:
                    step[t] = np.linalg.solve(state[t][2], state[t][1])
                if done:
                    fit.covariance = np.linalg.inv(state[t][2])
            except np.linalg.LinAlgError:
                fit.lost = done = True
            if done:
                del trial[t]
            else:
                trial[t] = fit.beta + step[t]
    return fits


def _label_moments(rows: DataFrame, features: int, targets: int) -> list[tuple[int, Design]]:
    """(true labels, moments of the features) of each target's complete rows, in one scan for all."""
    width = features + 1

    def own(batches):
        for batch in batches:
            cells = matrix_of(batch)
            parts = []
            for t in range(targets):
                kept = cells[~np.isnan(cells[:, features + t])]
                parts.append(matrix_moments(kept[:, [*range(features), features + t]]))
            yield Moments(*(np.stack([getattr(p, f) for p in parts]) for f in ("n", "mean_a", "mean_b", "square_a", "square_b", "cross")))

    m = merged_over(rows, own, targets, width, width)
    out = []
    for t in range(targets):
        n = int(m.n[t, -1, -1])
        out.append((round(n * m.mean_a[t, -1, -1]), Design(n, np.diag(m.mean_a[t])[:features].copy(), m.cross[t, :features, :features])))
    return out


def logistic_models(df: DataFrame, kinds: list[ColumnKind]) -> tuple[DataFrame, DataFrame]:
    """One model per boolean column, all fitted together: (models, coefficients). Maximum likelihood with Wald inference."""
    spark, numeric, targets = df.sparkSession, of_kind(kinds, "numeric"), of_kind(kinds, "boolean")
    names = [k.name for k in numeric]
    cols = [f"c{i}" for i in range(len(names))]
    labels = [f"y{t}" for t in range(len(targets))]
    models: dict[int, tuple] = {}
    coefficients: list[tuple] = []

    def skip(t: int, reason: str) -> None:
        models[t] = _skipped_model(targets[t].name, "logistic", reason)

    rows = df.select(
        *[typed_cell(df, k).alias(c) for k, c in zip(numeric, cols)],
        *[typed_cell(df, k).cast("double").alias(y) for k, y in zip(targets, labels)],
    )
    if cols:
        rows = rows.na.drop(subset=cols)
    rows = ranking.hold(rows)
    try:
        starts = {}
        for t, (ones, design) in enumerate(_label_moments(rows, len(cols), len(labels)) if labels else []):
            smaller = min(ones, design.n - ones)
            active = [i for i in range(len(cols)) if design.products[i, i] > 0]
            if design.n < MIN_LOGISTIC_ROWS:
                skip(t, FEW_LOGISTIC_ROWS.format(MIN_LOGISTIC_ROWS, design.n))
            elif smaller < MIN_MINORITY:
                skip(t, SMALL_CLASS.format(smaller, MIN_MINORITY))
            elif not active:
                skip(t, ALL_CONSTANT)
            elif _invert_scaled(design.products[np.ix_(active, active)]) is None:
                skip(t, COLLINEAR_LOGISTIC)
            else:
                starts[t] = (math.log(ones / (design.n - ones)), design, active)
        fits = fit_logits(rows, len(cols), starts)
        for t in [t for t, f in fits.items() if f.lost or f.covariance is None]:
            skip(t, COLLINEAR_LOGISTIC)
            del fits[t], starts[t]
        scored = {t: (logit_probability(fits[t].beta, *starts[t][1:]), F.col(labels[t])) for t in fits}
        quality = {r["pos"]: r for r in scores_quality(rows, scored).collect()} if scored else {}
    finally:
        rows.unpersist()
    for t, fit in fits.items():
        _, design, active = starts[t]
        sd, error = design.sd(), np.sqrt(np.maximum(np.diag(fit.covariance), 0.0))[1:]
        terms = []
        for b, e, i in zip(fit.beta[1:], error, active):
            estimate, se = float(b / sd[i]), float(e / sd[i])
            wald = estimate / se if se > 0 else 0.0
            p = math.erfc(abs(wald) / math.sqrt(2.0))
            odds = math.exp(estimate) if estimate < 700 else None
            terms.append((names[i], estimate, float(b), se, wald, p, p < ALPHA, odds, None))
        intercept = float(fit.beta[0]) - sum(float(b * design.means[i] / sd[i]) for b, i in zip(fit.beta[1:], active))
        q = quality[t]
        models[t] = (targets[t].name, "logistic", q["n"], None, None, intercept, q["auc"], q["accuracy"], q["true_count"],
                     q["false_count"], [], None, fit.converged, fit.rounds)
        coefficients += _ranked_coefficients(targets[t].name, "logistic", terms)
    return small_table(spark, [models[t] for t in sorted(models)], MODEL_SCHEMA), small_table(spark, coefficients, COEFFICIENT_SCHEMA)


# ----- all of it -------------------------------------------------------------


@dataclass
class Relations:
    pearson: DataFrame
    spearman: DataFrame
    records: DataFrame
    top: DataFrame
    models: DataFrame
    coefficients: DataFrame


def relate(df: DataFrame, kinds: list[ColumnKind]) -> Relations:
    """Correlations and regressions; empty tables below two numeric columns."""
    spark = df.sparkSession
    enough = len(of_kind(kinds, "numeric")) >= 2
    empty_pairs = small_table(spark, [], PAIR_SCHEMA)
    a, b = (pearson_pairs(df, kinds), spearman_pairs(df, kinds)) if enough else (empty_pairs, empty_pairs)
    a = small_table(spark, a.collect(), PAIR_SCHEMA)  # one row per pair
    a, b = with_p_values(a), with_p_values(b)
    keep = kinds if enough else []
    records = pair_records(a, b, keep)
    if enough:
        models, coefficients = linear_models(df, kinds)
        more, terms = logistic_models(df, kinds)
        models, coefficients = models.unionByName(more), coefficients.unionByName(terms)
    else:
        models, coefficients = small_table(spark, [], MODEL_SCHEMA), small_table(spark, [], COEFFICIENT_SCHEMA)
    return Relations(correlation_matrix(a, keep), correlation_matrix(b, keep), records, top_pairs(records), models, coefficients)
