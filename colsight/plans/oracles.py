"""The same results as SQL, for checking ``queries`` against another engine."""

from __future__ import annotations

from itertools import combinations

from colsight.functions.special import QUANTILE_DEN, QUANTILE_NUM, TAIL_DEN, TAIL_NUM

MISSING = "('', 'na', 'n/a', 'null', 'nan', '#n/a', '#na', '-', '--', '#null!')"
TRUE = "('true', 'yes', 'y', '1', 't')"
FALSE = "('false', 'no', 'n', '0', 'f')"
LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(expression: str, digits: int = 4) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


# ----- numeric profile -------------------------------------------------------


def numeric_base(column: str, source: str) -> str:
    """CTEs v, s, m, f, g over one column."""
    quantiles = ", ".join(f"quantile_cont(x, {q}) AS p{int(q * 100)}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    return f"""v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source}),
s AS (SELECT count(*) AS total_rows, count(*) - count(x) AS missing, count(x) AS n, avg(x) AS mean,
  coalesce(stddev_samp(x), 0.0) AS sd, min(x) AS lo, max(x) AS hi, skewness(x) AS sk, kurtosis(x) AS ku,
  count(*) FILTER (WHERE x = 0) AS zeros, bool_and(x = floor(x)) AS whole, {quantiles} FROM v),
m AS (SELECT median(abs(x - s.p50)) * 1.4826 AS mad FROM v, s),
f AS (SELECT count(*) FILTER (WHERE s.p75 > s.p25 AND (x < s.p25 - 1.5 * (s.p75 - s.p25) OR x > s.p75 + 1.5 * (s.p75 - s.p25))) AS tukey,
  count(*) FILTER (WHERE m.mad > 0 AND abs(0.6745 * (x - s.p50) / m.mad) > 3.5) AS far FROM v, s, m),
g AS (SELECT CASE WHEN sum(a) = 0 THEN 0.0 ELSE 2.0 * sum(rn * a) / (count(*) * sum(a)) - (count(*) + 1.0) / count(*) END AS gini
  FROM (SELECT abs(x) AS a, row_number() OVER (ORDER BY abs(x)) AS rn FROM v WHERE x IS NOT NULL))"""


def numeric_profile(source: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        percentiles = ", ".join(f"{r('s.p' + p)} AS p{p}" for p in ("1", "5", "25", "50", "75", "95", "99"))
        return f"""WITH {numeric_base(c, source)}
SELECT '{c}' AS name, s.total_rows, s.missing, {r('s.missing * 1.0 / s.total_rows')} AS missing_pct, s.n AS count,
  {r('s.mean')} AS mean, {r('s.sd')} AS std, {r('CASE WHEN s.mean <> 0 THEN s.sd / abs(s.mean) END')} AS cv,
  {r('s.p50')} AS median, {r('m.mad')} AS mad, {r('s.p75 - s.p25')} AS iqr, {r('s.lo')} AS min, {r('s.hi')} AS max,
  {percentiles}, {r('s.sk')} AS skew, {r('s.ku')} AS kurtosis_excess, f.tukey AS outlier_iqr_count,
  f.far AS outlier_robust_count, {r('g.gini')} AS gini, s.zeros AS zeros_count, 'standard' AS format_hint
FROM s, m, f, g"""
    return union([one(c) for c in columns])


def gini(pairs: list[tuple[str, str]]) -> str:
    return union([f"WITH {numeric_base(c, t)} SELECT '{c}' AS name, {r('g.gini', 6)} AS gini FROM g" for t, c in pairs])


def histogram(source: str, column: str, integers: str = "false") -> str:
    """Freedman-Diaconis bins with exact edge rules; ``integers`` holds widths at one or more."""
    return f"""WITH {numeric_base(column, source)},
w AS (SELECT s.*, 2.0 * (p75 - p25) * power(n, -1.0 / 3.0) AS raw FROM s),
b AS (SELECT *, CASE WHEN {integers} AND raw > 0 AND raw < 1 THEN 1.0 ELSE raw END AS width FROM w),
k AS (SELECT *, CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 1 END AS fd FROM b),
p AS (SELECT lo, hi, CAST(CASE WHEN fd BETWEEN 1 AND 40 THEN fd ELSE least(40, greatest(10, floor(sqrt(n)))) END AS BIGINT) AS bins FROM k),
q AS (SELECT x, p.*, least(CAST(floor((x - lo) * (bins / (hi - lo))) AS BIGINT), bins - 1) AS guess, (hi - lo) / bins AS step FROM v, p),
a AS (SELECT CASE WHEN x < lo + guess * step THEN guess - 1 WHEN x >= lo + (guess + 1) * step AND guess <> bins - 1 THEN guess + 1 ELSE guess END AS bin FROM q),
c AS (SELECT bin, count(*) AS cnt FROM a GROUP BY bin),
grid AS (SELECT unnest(range(p.bins)) AS bin, p.* FROM p)
SELECT '{column}' AS name, grid.bin, lo + grid.bin * ((hi - lo) / bins) AS bin_lo,
  CASE WHEN grid.bin = bins - 1 THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / bins) END AS bin_hi, coalesce(c.cnt, 0) AS cnt
FROM grid LEFT JOIN c ON grid.bin = c.bin"""


def rounded_histogram(sql: str) -> str:
    return f"SELECT name, bin, {r('bin_lo')} AS bin_lo, {r('bin_hi')} AS bin_hi, cnt FROM ({sql})"


OUTLIERS = f"""WITH {numeric_base('value', 'events')},
z AS (SELECT x, 0.6745 * (x - s.p50) / m.mad AS z FROM v, s, m WHERE m.mad > 0),
o AS (SELECT x, z, row_number() OVER (ORDER BY abs(z) DESC, x) AS rn FROM z WHERE abs(z) > 3.5)
SELECT 'value' AS name, rn AS rank, {r('x')} AS value, {r('z')} AS z FROM o WHERE rn <= 50"""

YEARS = """SELECT 'order_year' AS name, CASE WHEN min(year(o_orderdate)) >= 1800 AND max(year(o_orderdate)) <= 2200 THEN 'year' ELSE 'standard' END AS format_hint FROM orders
UNION ALL SELECT 'month_of_year', CASE WHEN min(month(o_orderdate)) >= 1800 AND max(month(o_orderdate)) <= 2200 THEN 'year' ELSE 'standard' END FROM orders
UNION ALL SELECT 'mid_year', 'standard' UNION ALL SELECT 'ordered', 'standard'"""


# ----- other profiles --------------------------------------------------------


def categorical(pairs: list[tuple[str, str]]) -> str:
    def one(t: str, c: str) -> str:
        return f"""WITH c AS (SELECT trim({c}) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND trim({c}) <> '' GROUP BY 1),
a AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS missing FROM {t}),
b AS (SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS unique_count, max(n) AS mode_frequency FROM c)
SELECT '{c}' AS name, a.total_rows, a.missing, {r('a.missing * 1.0 / a.total_rows', 6)} AS missing_pct, b.count, b.unique_count,
  (SELECT min(v) FROM c, b WHERE n = b.mode_frequency) AS mode, b.mode_frequency,
  {r('(SELECT CASE WHEN count(*) <= 1 THEN 0.0 ELSE -sum(n * 1.0 / b2.count * log2(n * 1.0 / b2.count)) / log2(count(*)) END FROM c, (SELECT sum(n) AS count FROM c) b2)', 6)} AS entropy_normalized,
  (SELECT count(*) FROM c, b b3 WHERE (b3.mode_frequency - n) * 1.0 / b3.count < 0.0005) AS tied_count
FROM a, b"""
    return union([one(t, c) for t, c in pairs])


def top_values(pairs: list[tuple[str, str]]) -> str:
    return union([f"""SELECT '{c}' AS name, rn AS rank, v AS value, n AS cnt, {r('n * 1.0 / total', 6)} AS pct FROM (
  SELECT v, n, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, v) AS rn FROM (
    SELECT trim({c}) AS v, count(*) AS n FROM {t} GROUP BY 1)) WHERE rn <= 5""" for t, c in pairs])


def boolean(cases: list[tuple[str, str]]) -> str:
    return union([f"""SELECT '{name}' AS name, count(*) AS total_rows, count(*) FILTER (WHERE v IS NULL) AS missing,
  {r('count(*) FILTER (WHERE v IS NULL) * 1.0 / count(*)', 6)} AS missing_pct,
  count(*) FILTER (WHERE v IN {TRUE}) + count(*) FILTER (WHERE v IN {FALSE}) AS count,
  count(*) FILTER (WHERE v IN {TRUE}) AS true_count, count(*) FILTER (WHERE v IN {FALSE}) AS false_count,
  {r(f'count(*) FILTER (WHERE v IN {TRUE}) * 1.0 / count(*) FILTER (WHERE v IN {TRUE} OR v IN {FALSE})', 6)} AS true_pct
FROM (SELECT lower({expr}) AS v FROM labels)""" for name, expr in cases])


GRANULARITY = """CASE WHEN g IS NULL THEN 'irregular' WHEN g <= 1.5 THEN 'daily' WHEN g <= 9 THEN 'weekly' WHEN g <= 45 THEN 'monthly'
 WHEN g <= 130 THEN 'quarterly' WHEN g <= 400 THEN 'yearly' ELSE 'irregular' END"""
EXPECTED = """CASE WHEN g <= 1.5 THEN 1.0 WHEN g <= 9 THEN 7.0 WHEN g <= 45 THEN 30.4375 WHEN g <= 130 THEN 91.3125 WHEN g <= 400 THEN 365.25 END"""
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def datetimes(pairs: list[tuple[str, str]]) -> str:
    return union([f"""WITH d AS (SELECT date_diff('microsecond', lag({c}) OVER (ORDER BY {c}), {c}) / 86400000000.0 AS gap FROM {t} WHERE {c} IS NOT NULL),
m AS (SELECT median(gap) AS g FROM d),
e AS (SELECT count(*) FILTER (WHERE gap > 1.5 * ({EXPECTED})) AS gaps FROM d, m)
SELECT '{c}' AS name, count(*) AS total_rows, count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) * 1.0 / count(*)', 6)} AS missing_pct,
  count({c}) AS count, strftime(min({c}), {STAMP}) AS min_date, strftime(max({c}), {STAMP}) AS max_date,
  CAST(floor(date_diff('microsecond', min({c}), max({c})) / 86400000000.0) AS BIGINT) AS range_days,
  (SELECT {GRANULARITY} FROM m) AS granularity, (SELECT gaps FROM e) AS gap_count FROM {t}""" for t, c in pairs])


# ----- dirty text ------------------------------------------------------------

DIRTY = """SELECT o_orderkey AS k,
 CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
 CASE WHEN o_orderkey % 29 = 0 THEN ' nan ' WHEN o_orderkey % 31 = 0 THEN '1d' WHEN o_orderkey % 37 = 0 THEN '+.5'
  ELSE CAST(o_orderkey % 9 AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS amount,
 CASE WHEN o_orderkey % 19 = 0 THEN '--' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
 CASE WHEN o_orderkey % 13 = 0 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'n' END AS flag,
 o_orderpriority AS priority, '#N/A' AS empty FROM orders"""
CLEAN_COLUMNS = ["price", "amount", "day", "flag", "priority", "empty"]


def clean(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN {MISSING} THEN NULL ELSE {column} END"


NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def to_number(column: str) -> str:
    plain = f"replace({column}, ',', '')"
    return f"CASE WHEN regexp_matches({plain}, {NUMBER}) THEN TRY_CAST(trim({plain}) AS DOUBLE) END"


def missing_report() -> str:
    rows = union([f"SELECT '{c}' AS name, CAST({i} AS BIGINT) AS position, count(*) FILTER (WHERE ({clean(c)}) IS NULL) AS missing, count(*) AS n FROM dirty"
                  for i, c in enumerate(CLEAN_COLUMNS)])
    return f"WITH dirty AS ({DIRTY}) SELECT name, position, missing, {r('missing * 1.0 / n', 6)} AS missing_pct FROM ({rows}) WHERE missing > 0"


def infer_kinds() -> str:
    """Every non-blank cell votes; the shown samples are the first five."""
    sources = {"k": "lpad(CAST(k AS VARCHAR), 12, '0')", **{c: clean(c) for c in CLEAN_COLUMNS},
               "late": f"CASE WHEN k <= 250 THEN CAST(k AS VARCHAR) ELSE {clean('priority')} END",
               "moment": f"({clean('day')}) || ' 10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0')"}

    def one(i: int, c: str) -> str:
        return f"""SELECT '{c}' AS name, CAST({i} AS BIGINT) AS position,
  CASE WHEN n = 0 THEN 'unknown' WHEN b >= ceil(0.9 * n) THEN 'boolean' WHEN u >= ceil(0.9 * n) THEN 'numeric' WHEN d + t >= ceil(0.9 * n) THEN 'datetime' ELSE 'categorical' END AS kind,
  (SELECT count(*) FILTER (WHERE ({sources[c]}) IS NULL) FROM dirty) AS missing_count, coalesce(shown, '') AS sample_values,
  CASE WHEN n > 0 AND b < ceil(0.9 * n) AND u < ceil(0.9 * n) AND d + t >= ceil(0.9 * n) THEN CASE WHEN d >= t THEN 'iso_date' ELSE 'iso_datetime' END END AS date_layout
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE lower(v) IN {TRUE} OR lower(v) IN {FALSE}) AS b,
  count(*) FILTER (WHERE regexp_matches(replace(v, ',', ''), '^-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?$')) AS u,
  count(*) FILTER (WHERE regexp_matches(v, '[-/:]') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS d,
  count(*) FILTER (WHERE regexp_matches(v, '[-/:]') AND try_strptime(v, '%Y-%m-%d %H:%M') IS NOT NULL) AS t,
  string_agg(v, '|' ORDER BY rn) FILTER (WHERE rn <= 5) AS shown
  FROM (SELECT v, row_number() OVER (ORDER BY k) AS rn FROM (SELECT k, trim({sources[c]}) AS v FROM dirty) WHERE v <> ''))"""
    return f"WITH dirty AS ({DIRTY}) " + union([one(i, c) for i, c in enumerate(sources)])


READ_FILES = """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
 o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'next, line' WHEN o_orderkey % 7 = 0 THEN ' said "so"' ELSE '' END AS note,
 CASE WHEN o_orderkey % 2 = 1 THEN 'x' END AS more FROM orders"""


# ----- tails of distributions, by Simpson's rule -----------------------------


def simpson(low: str, high: str, value: str, steps: int = 4000) -> str:
    """The integral of ``value`` (of x) from low to high."""
    return (f"(SELECT sum(w * ({value})) * (({high}) - ({low})) / (3.0 * {steps}) FROM (SELECT ({low}) + (({high}) - ({low})) * i / {steps}.0 AS x, "
            f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END AS w FROM range({steps + 1}) q(i)))")


def normal_above(z: str) -> str:
    return f"CASE WHEN {z} < -8 THEN 1.0 ELSE {simpson(z, f'({z} + 12)', 'exp(-x * x / 2) / sqrt(2 * pi())')} END"


def student_p(t: str, dof: str) -> str:
    """Two-sided tail of Student's t; x is the angle whose tangent is t by the root of the degrees of freedom."""
    front = f"2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi())"
    return f"({front} * {simpson(f'atan(abs({t}) / sqrt({dof}))', 'pi() / 2', f'power(cos(x), {dof} - 1)', 20000)})"


def normality(pairs: list[tuple[str, str]]) -> str:
    """Squared correlation of values with the normal scores of their ranks, and its place on a normal scale."""
    poly = lambda x, c: "(" + "(" * (len(c) - 1) + f"{c[0]!r}" + "".join(f") * {x} + {v!r}" for v in c[1:]) + ")"
    middle = f"((p - 0.5) * {poly('((p - 0.5) * (p - 0.5))', QUANTILE_NUM)} / {poly('((p - 0.5) * (p - 0.5))', QUANTILE_DEN)})"
    tail = f"({poly('far', TAIL_NUM)} / {poly('far', TAIL_DEN)})"

    def one(t: str, c: str) -> str:
        return f"""WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL), s AS (SELECT count(*) AS n, avg(x) AS mean, count(DISTINCT x) AS kinds FROM v),
k AS (SELECT x, count(*) AS c, sum(count(*)) OVER (ORDER BY x) - count(*) + (count(*) + 1) / 2.0 AS rank FROM v GROUP BY x),
q AS (SELECT x, c, (rank - 0.375) / (n + 0.25) AS p, (n - rank + 0.625) / (n + 0.25) AS rest, mean FROM k, s),
f AS (SELECT *, sqrt(-2 * ln(least(p, rest))) AS far FROM q),
m AS (SELECT x, c, mean, CASE WHEN p < 0.02425 THEN {tail} WHEN rest < 0.02425 THEN -{tail} ELSE {middle} END AS m FROM f),
w AS (SELECT power(sum(c * m * (x - mean)), 2) / ((sum(c * m * m) - power(sum(c * m), 2) / sum(c)) * sum(c * (x - mean) * (x - mean))) AS w FROM m),
z AS (SELECT w, n, (ln(1 - w) + 1.2725 - 1.0521 * (ln(ln(n)) - ln(n))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM w, s)
SELECT '{c}' AS name, n AS count, 'shapiro_francia' AS normality_test, {r('w', 6)} AS normality_statistic, {r(normal_above('z'), 6)} AS normality_p FROM z"""
    return union([one(t, c) for t, c in pairs])


# ----- relations -------------------------------------------------------------

RELATED = """SELECT l_quantity, l_extendedprice, l_extendedprice * (1 + l_tax) AS charge, 60.0 - l_quantity + l_discount * 40 AS spare,
 power(l_quantity / 10, 20.0) AS steep FROM lineitem"""
GAPPY = """SELECT l_quantity AS a, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS b,
 CASE WHEN l_linenumber <> 3 THEN l_discount + l_quantity / 100 END AS c FROM lineitem"""


def pearson(columns: list[str], source: str, digits: int = 6, method: str | None = None) -> str:
    tag = f"'{method}' AS method, " if method else ""
    return union([
        f"SELECT {tag}'{a}' AS col_i, '{b}' AS col_j, {r(f'corr({a}, {b})', digits)} AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM ({source})"
        for a, b in combinations(columns, 2)])


def spearman(columns: list[str], source: str, digits: int = 6, method: str | None = None) -> str:
    tag = f"'{method}' AS method, " if method else ""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return union([
        f"""SELECT {tag}'{a}' AS col_i, '{b}' AS col_j, {r('corr(ra, rb)', digits)} AS r, count(*) AS n FROM (
  SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM ({source}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in combinations(columns, 2)])


RELATED_COLUMNS = ["l_quantity", "l_extendedprice", "charge", "spare", "steep"]


def records() -> str:
    """CTE rec: one row per pair with both coefficients and the hint."""
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(RELATED_COLUMNS))
    return f"""pe AS ({pearson(RELATED_COLUMNS, RELATED, 15)}), sp AS ({spearman(RELATED_COLUMNS, RELATED, 15)}),
ord AS (SELECT * FROM (VALUES {order}) t(c, o)),
rec AS (SELECT pe.col_i AS column_a, pe.col_j AS column_b, pe.r AS pearson, sp.r AS spearman,
  abs(sp.r - pe.r) >= 0.2 AND greatest(abs(pe.r), abs(sp.r)) >= 0.4 AS non_linear_hint, x.o AS i, y.o AS j
  FROM pe JOIN sp USING (col_i, col_j) JOIN ord x ON pe.col_i = x.c JOIN ord y ON pe.col_j = y.c)"""


PAIR_RECORDS = f"WITH {records()} SELECT column_a, column_b, {r('pearson', 6)} AS pearson, {r('spearman', 6)} AS spearman, non_linear_hint FROM rec"
TOP_PAIRS = f"""WITH {records()},
hint AS (SELECT *, row_number() OVER (ORDER BY abs(spearman - pearson) DESC, i, j) AS rn FROM rec WHERE non_linear_hint),
shown AS (SELECT * FROM hint WHERE rn <= 3),
rest AS (SELECT * FROM rec WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.column_a = rec.column_a AND shown.column_b = rec.column_b)),
pos AS (SELECT *, row_number() OVER (ORDER BY pearson DESC, i, j) AS rn FROM rest WHERE pearson >= 0.15),
neg AS (SELECT *, row_number() OVER (ORDER BY pearson, i, j) AS rn FROM rest WHERE pearson <= -0.15),
al AS (SELECT 'non_linear' AS bucket, * FROM shown UNION ALL SELECT 'positive', * FROM pos WHERE rn <= 3 UNION ALL SELECT 'negative', * FROM neg WHERE rn <= 3)
SELECT bucket, rn AS rank, column_a, column_b, {r('pearson', 6)} AS pearson, {r('spearman', 6)} AS spearman FROM al"""

PAIR_FINDINGS = f"""WITH {records()}, g AS (SELECT *, greatest(abs(pearson), abs(spearman)) AS r FROM rec)
SELECT column_a || ' ~ ' || column_b AS subject,
 CASE WHEN non_linear_hint THEN 'non_linear' WHEN r >= 0.95 THEN 'identical' WHEN r >= 0.85 THEN 'very_strong' WHEN r >= 0.7 THEN 'strong'
  WHEN r >= 0.4 THEN 'moderate' WHEN r >= 0.2 THEN 'weak' ELSE 'very_weak' END AS rule,
 CASE WHEN non_linear_hint THEN 'note' WHEN r >= 0.7 THEN 'info' ELSE 'note' END AS severity FROM g"""


def ols_simple() -> str:
    source = "SELECT o_totalprice, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders"
    def one(y: str, x: str) -> str:
        return f"""SELECT '{y}' AS target, '{x}' AS feature, n AS n_observations, {r('b', 6)} AS estimate, {r('a', 6)} AS intercept, {r('r2', 6)} AS r_squared,
  {r('1 - (1 - r2) * (n - 1) / (n - 2)', 6)} AS adjusted_r_squared, {r('se', 6)} AS standard_error, {r('b / se', 6)} AS statistic,
  {r('b * sqrt(sxx / syy)', 6)} AS standardized_estimate
FROM (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM (SELECT count(*) AS n, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a,
  regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM ({source})))"""
    return union([one("o_totalprice", "day"), one("day", "o_totalprice")])


def two_feature_models(columns: list[str], select: str) -> str:
    """Least squares of each of three columns on the other two, in closed form."""
    a, b, c = columns
    def one(y: str, u: str, v: str) -> str:
        base = f"""SELECT count(*) AS n, avg({y}) AS my, avg({u}) AS mu, avg({v}) AS mv, regr_sxx({u}, {u}) AS suu, regr_sxx({v}, {v}) AS svv,
  regr_sxx({y}, {y}) AS syy, regr_sxy({u}, {v}) AS suv, regr_sxy({y}, {u}) AS syu, regr_sxy({y}, {v}) AS syv FROM ({RELATED})"""
        solved = f"""SELECT *, suu * svv - suv * suv AS det, (svv * syu - suv * syv) / (suu * svv - suv * suv) AS bu, (suu * syv - suv * syu) / (suu * svv - suv * suv) AS bv FROM ({base})"""
        fit = f"""SELECT *, my - bu * mu - bv * mv AS intercept, syy - bu * syu - bv * syv AS rss, 1 / (1 - suv * suv / (suu * svv)) AS vif FROM ({solved})"""
        return f"""SELECT '{y}' AS target, f.feature, n AS n_observations, f.estimate, intercept, 1 - rss / syy AS r_squared,
  sqrt(rss / (n - 3) * f.scale / det) AS standard_error, f.standardized AS standardized_estimate, vif,
  row_number() OVER (ORDER BY abs(f.standardized) DESC, f.feature) AS rank
FROM ({fit}) m, LATERAL (VALUES ('{u}', bu, svv, bu * sqrt(suu / syy)), ('{v}', bv, suu, bv * sqrt(svv / syy))) f(feature, estimate, scale, standardized)"""
    return f"SELECT {select} FROM ({union([one(a, b, c), one(b, a, c), one(c, a, b)])})"


OLS_FULL = two_feature_models(
    ["l_quantity", "charge", "spare"],
    f"target, feature, rank, n_observations, {r('estimate', 5)} AS estimate, {r('intercept', 5)} AS intercept, {r('r_squared', 5)} AS r_squared, "
    f"{r('standard_error', 5)} AS standard_error, {r('standardized_estimate', 5)} AS standardized_estimate")
VIF = two_feature_models(["l_quantity", "spare", "charge"], f"target, feature, {r('vif', 5)} AS vif, vif > 10 AS high")

AUC = f"""WITH s AS (SELECT l_extendedprice / 110000.0 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM s),
a AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, sum(rk * y) AS rs, avg(CASE WHEN (s >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM k)
SELECT n, pos AS true_count, n - pos AS false_count, {r('(rs - pos * (pos + 1) / 2.0) / (pos * 1.0 * (n - pos))', 6)} AS auc, {r('acc', 6)} AS accuracy FROM a"""

# ----- segments --------------------------------------------------------------

ZSCORE = f"""SELECT p_partkey, {r('(p_size - ms) / ss', 6)} AS z_p_size, {r('(p_retailprice - mp) / sp', 6)} AS z_p_retailprice FROM part,
 (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM part)"""
PCA_VARIANCE = f"""SELECT count(*) AS n, {r('(1 + abs(corr(p_size, p_retailprice))) / 2', 6)} AS first,
 {r('(1 - abs(corr(p_size, p_retailprice))) / 2', 6)} AS second, 1.0 AS total FROM part"""
SILHOUETTE = f"""WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, s_nationkey % 3 AS c FROM supplier),
d AS (SELECT a.id, a.c AS own, b.c AS other, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS total, count(*) AS m FROM p a, p b GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN own = other THEN m END) AS n_own, max(CASE WHEN own = other THEN total / greatest(m - 1, 1) END) AS a,
  min(CASE WHEN own <> other THEN total / m END) AS b FROM d GROUP BY id)
SELECT count(*) AS n, {r('avg(CASE WHEN n_own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)', 6)} AS silhouette FROM s"""


def cluster_summary() -> str:
    rows = union([f"""SELECT p_size % 3 AS cluster, '{f}' AS feature, avg({f}) AS center_value,
  (avg({f}) - (SELECT avg({f}) FROM part)) / (SELECT stddev_samp({f}) FROM part) AS deviation FROM part GROUP BY 1""" for f in ("p_size", "p_retailprice")])
    return f"""WITH f AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(deviation) DESC, feature) AS rank FROM f),
n AS (SELECT p_size % 3 AS cluster, count(*) AS size, count(*) * 1.0 / (SELECT count(*) FROM part) AS pct FROM part GROUP BY 1)
SELECT CAST(k.cluster AS BIGINT) AS cluster, 'Group ' || chr(CAST(65 + k.cluster AS INTEGER)) AS label, n.size, {r('n.pct', 6)} AS size_pct, k.rank, k.feature,
 {r('k.center_value', 6)} AS center_value, {r('k.deviation', 6)} AS deviation FROM k JOIN n ON k.cluster = n.cluster WHERE k.rank <= 3"""


# ----- trends ----------------------------------------------------------------

TREND = """e AS (SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, avg(value) AS mean_value FROM events),
x AS (SELECT date_diff('microsecond', e.first_ts, ts) / 86400000000.0 AS x, value AS y, ts FROM events, e),
fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2,
  sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / greatest(count(*) - 2, 1)) AS sd, max(x) AS last_day FROM x),
d AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 86400000000.0 AS gap FROM events),
m AS (SELECT median(gap) AS g FROM d)"""
TREND_FIT = f"""WITH {TREND} SELECT 'ts' AS datetime_column, 'value' AS value_column, e.n AS n_observations, strftime(e.first_ts, {STAMP}) AS first_at,
 strftime(e.last_ts, {STAMP}) AS last_at, {r('fit.last_day', 5)} AS last_day, {r('e.mean_value', 5)} AS mean_value, {r('fit.slope', 5)} AS trend_slope, {r('fit.intercept', 5)} AS trend_intercept,
 {r('fit.r2', 5)} AS trend_r_squared, {r('fit.sd', 5)} AS residual_std, {r('m.g', 5)} AS median_gap_days,
 CASE WHEN m.g <= 0 THEN 'irregular' ELSE {GRANULARITY} END AS cadence_label FROM e, fit, m"""
FORECAST = f"""WITH {TREND}, h AS (SELECT least(12, greatest(1, CAST(floor(e.n * 0.25) AS BIGINT))) AS h FROM e), i AS (SELECT unnest(range(1, h + 1)) AS step FROM h),
o AS (SELECT step, g * step AS ahead, slope * (last_day + g * step) + intercept AS v, sd, last_ts FROM i, fit, m, e)
SELECT 'ts' AS datetime_column, 'value' AS value_column, step, strftime(last_ts + to_microseconds(CAST(round(ahead * 86400000000.0) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at,
 {r('v')} AS value, {r('v - 1.96 * sd')} AS lower_95, {r('v + 1.96 * sd')} AS upper_95 FROM o"""
ANCHORS = f"""WITH {TREND} SELECT 'ts' AS datetime_column, 'value' AS value_column, 'first' AS "end", strftime(e.first_ts, {STAMP}) AS at, {r('fit.intercept')} AS value FROM e, fit
UNION ALL SELECT 'ts', 'value', 'last', strftime(e.last_ts, {STAMP}), {r('fit.intercept + fit.slope * fit.last_day')} FROM e, fit"""
HISTORY = f"SELECT 'ts' AS datetime_column, 'value' AS value_column, strftime(ts, {STAMP}) AS at, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL"
TREND_FINDINGS = f"""WITH {TREND}, t AS (SELECT abs(slope * g) / greatest(abs(mean_value), 1e-9) AS move, slope, r2 FROM e, fit, m)
SELECT 'ts ~ value' AS subject, CAST(0 AS BIGINT) AS position, CASE WHEN move < 0.005 THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS rule,
 CASE WHEN move >= 0.005 AND slope <= 0 THEN 'warning' ELSE 'info' END AS severity FROM t
UNION ALL SELECT 'ts ~ value', 1, 'forecast', 'info' FROM t
UNION ALL SELECT 'ts ~ value', 2, CASE WHEN r2 >= 0.15 THEN 'noisy' ELSE 'no_trend' END, CASE WHEN r2 >= 0.15 THEN 'note' ELSE 'warning' END FROM t WHERE r2 < 0.5"""


def series_gate(pairs: list[tuple[str, str]]) -> str:
    return union([f"""SELECT '{c}' AS datetime_column, n, d AS distinct_times, reason IS NULL AS eligible, reason FROM (
  SELECT n, d, CASE WHEN n = 0 THEN 'no dates' WHEN d < 10 THEN 'too few distinct times' WHEN d < n * 0.95 THEN 'repeated times' END AS reason
  FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d FROM {t}))""" for t, c in pairs])


# ----- findings --------------------------------------------------------------


def numeric_findings(pairs: list[tuple[str, str]]) -> str:
    """Rule and severity per column, without the normality rule."""
    def one(t: str, c: str) -> str:
        return f"""WITH {numeric_base(c, t)}, q AS (SELECT s.*, m.mad, f.far, g.gini, CASE WHEN s.mean <> 0 THEN s.sd / abs(s.mean) END AS cv FROM s, m, f, g),
u AS (SELECT 0 AS slot, CASE WHEN sd = 0 OR abs(cv) < 1e-6 THEN 'constant' WHEN abs(sk) >= 1.5 THEN 'strong_skew' WHEN abs(sk) >= 0.5 THEN 'mild_skew' ELSE 'range' END AS rule,
  CASE WHEN sd = 0 OR abs(cv) < 1e-6 THEN 'warning' ELSE 'info' END AS severity FROM q
UNION ALL SELECT 1, CASE WHEN cv >= 1.0 THEN 'spread_wide' ELSE 'spread_tight' END, 'note' FROM q WHERE cv >= 1.0 OR (cv < 0.1 AND sd > 0)
UNION ALL SELECT 2, CASE WHEN far > 0 THEN 'outliers' ELSE 'heavy_tails' END, CASE WHEN far * 1.0 / n > 0.05 THEN 'warning' ELSE 'note' END FROM q WHERE far > 0 OR ku >= 3
UNION ALL SELECT 3, 'concentration', 'info' FROM q WHERE gini >= 0.5
UNION ALL SELECT 4, CASE WHEN zeros > n * 0.5 THEN 'mostly_zeros' WHEN missing >= 0.2 * total_rows THEN 'missing_high' ELSE 'missing_notable' END,
  CASE WHEN zeros > n * 0.5 OR missing >= 0.2 * total_rows THEN 'warning' ELSE 'note' END FROM q WHERE zeros > n * 0.5 OR missing >= 0.05 * total_rows)
SELECT '{c}' AS subject, row_number() OVER (ORDER BY slot) - 1 AS position, rule, severity FROM u"""
    return union([one(t, c) for t, c in pairs])


def categorical_findings(cases: list[tuple[str, str]]) -> str:
    def one(name: str, expr: str) -> str:
        return f"""WITH c AS (SELECT {expr} AS v, count(*) AS n FROM part GROUP BY 1), a AS (SELECT sum(n) AS total, count(*) AS k, max(n) AS top FROM c),
t AS (SELECT count(*) AS tied FROM (SELECT n, row_number() OVER (ORDER BY n DESC, v) AS rn FROM c), a WHERE rn <= 5 AND abs(n * 1.0 / total - top * 1.0 / total) < 0.0005),
h AS (SELECT CASE WHEN a.k <= 1 THEN 0 ELSE -sum(n * 1.0 / total * log2(n * 1.0 / total)) / log2(max(a.k)) END AS h FROM c, a GROUP BY a.k)
SELECT '{name}' AS subject, row_number() OVER (ORDER BY slot) - 1 AS position, rule, severity FROM (
 SELECT 0 AS slot, CASE WHEN k = total THEN 'identifier' WHEN k <= 2 THEN 'two_state' WHEN tied >= 2 THEN 'tied_lead' ELSE 'leader' END AS rule,
  CASE WHEN k = total THEN 'note' ELSE 'info' END AS severity FROM a, t
 UNION ALL SELECT 1, CASE WHEN h <= 0.4 THEN 'few_dominate' ELSE 'even_spread' END, CASE WHEN h <= 0.4 THEN 'note' ELSE 'info' END FROM a, h WHERE k > 2 AND (h <= 0.4 OR h >= 0.85))"""
    return union([one(n, e) for n, e in cases])


MODEL_FINDINGS = f"""WITH m AS ({two_feature_models(["l_quantity", "charge", "spare"], "*, estimate / standard_error AS t")})
SELECT target AS subject, row_number() OVER (PARTITION BY target ORDER BY slot) - 1 AS position, rule, severity FROM (
 SELECT target, 0 AS slot, CASE WHEN r_squared >= 0.7 THEN 'fit_excellent' WHEN r_squared >= 0.5 THEN 'fit_good' WHEN r_squared >= 0.2 THEN 'fit_modest' ELSE 'fit_poor' END AS rule,
  CASE WHEN r_squared >= 0.5 THEN 'info' WHEN r_squared >= 0.2 THEN 'note' ELSE 'warning' END AS severity FROM m WHERE rank = 1
 UNION ALL SELECT target, 1, 'top_predictor', CASE WHEN abs(t) > 1.96 THEN 'info' ELSE 'note' END FROM m WHERE rank = 1
 UNION ALL SELECT target, 2, 'runner_up', 'info' FROM m WHERE rank = 2 AND abs(t) > 1.96 AND abs(standardized_estimate) > 0.15
 UNION ALL SELECT target, 3, 'overlap', 'warning' FROM m WHERE rank = 1 AND vif > 10)"""

BOOLEAN_FINDINGS = union([
    *[f"""SELECT '{c}' AS subject, CAST(0 AS BIGINT) AS position, CASE WHEN abs(avg({c}) - 0.5) >= 0.3 THEN 'imbalanced' ELSE 'balanced' END AS rule,
  CASE WHEN abs(avg({c}) - 0.5) >= 0.3 THEN 'warning' ELSE 'info' END AS severity FROM labels""" for c in ("quality", "toxic")],
    "SELECT 'o_orderdate' AS subject, CAST(0 AS BIGINT) AS position, 'coverage' AS rule, 'info' AS severity",
    f"SELECT name AS subject, CAST(1 AS BIGINT) AS position, 'gaps' AS rule, 'note' AS severity FROM ({datetimes([('orders', 'o_orderdate')])}) WHERE gap_count > 0",
])


def compact(x: str) -> str:
    return f"""CASE WHEN abs({x}) >= 1e9 THEN printf('%.2fB', {x} / 1e9) WHEN abs({x}) >= 1e6 THEN printf('%.2fM', {x} / 1e6)
  WHEN abs({x}) >= 1e3 THEN printf('%.2fk', {x} / 1e3) WHEN abs({x}) >= 10 THEN printf('%.1f', {x}) WHEN abs({x}) >= 1 THEN printf('%.2f', {x})
  WHEN abs({x}) >= 0.01 THEN printf('%.3f', {x}) ELSE regexp_replace(printf('%.2e', {x}), 'e([+-])0*([0-9])', 'e\\1\\2') END"""


FORMATS = f"""SELECT o_orderkey, {compact('p')} AS number, {compact('(p / 1e7)')} AS small,
 CASE WHEN p / 1e6 * 100 >= 10 THEN printf('%.0f%%', p / 1e6 * 100) WHEN p / 1e6 * 100 >= 1 THEN printf('%.1f%%', p / 1e6 * 100) ELSE printf('%.2f%%', p / 1e6 * 100) END AS share,
 CASE WHEN p / 1e7 < 0.001 THEN '< 0.001' WHEN p / 1e7 < 0.01 THEN printf('= %.3f', p / 1e7) ELSE printf('= %.2f', p / 1e7) END AS p,
 format('{{:,}}', o_orderkey) AS n, strftime(o_orderdate, '%Y-%m-%d') AS day,
 CASE WHEN p < 1024 THEN CAST(CAST(floor(p) AS BIGINT) AS VARCHAR) || ' B' WHEN p < 1048576 THEN printf('%.1f KB', p / 1024) ELSE printf('%.2f MB', p / 1048576) END AS bytes
FROM (SELECT *, o_totalprice * 1.0000037 AS p FROM orders)"""

TEXT_PREVIEW = r"""SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, CASE WHEN trim(lang) = '' OR lang IS NULL THEN '·' ELSE trim(lang) END AS lang,
 CASE WHEN t = '' OR t IS NULL THEN '·' WHEN length(t) > 40 THEN substring(t, 1, 40) || '…' ELSE t END AS text
FROM (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents ORDER BY doc_id LIMIT 10)"""

MALFORMED = """SELECT line FROM (SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), '"' || o_orderpriority || '"',
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END, CASE WHEN o_orderkey % 11 = 0 THEN 'extra' END) AS line,
  3 - CAST(o_orderkey % 7 = 0 AS INTEGER) + CAST(o_orderkey % 11 = 0 AS INTEGER) AS fields FROM orders) WHERE fields <> 3"""

PEARSON_EMBEDDINGS = f"""WITH e AS (SELECT row_number() OVER () AS rid, embedding FROM embeddings),
c AS (SELECT rid, unnest(range(64)) AS i, CAST(unnest(embedding[1:64]) AS DOUBLE) AS x FROM e)
SELECT 'e' || a.i AS col_i, 'e' || b.i AS col_j, {r('corr(a.x, b.x)', 6)} AS r, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS n
FROM c a JOIN c b ON a.rid = b.rid AND a.i < b.i GROUP BY a.i, b.i"""
CUSTOMER_WEEK = "SELECT c_acctbal, c_nationkey, c_custkey % 7 AS week FROM customer"
PAIR_P_VALUES = (f"SELECT method, col_i, col_j, r, {r(student_p('(r0 * sqrt((n - 2) / (1 - r0 * r0)))', '(n - 2)'), 6)} AS p, n FROM ("
                 + union([f"SELECT '{m}' AS method, '{a}' AS col_i, '{b}' AS col_j, corr({v % a}, {v % b}) AS r0, {r(f'corr({v % a}, {v % b})', 6)} AS r, count(*) AS n FROM ("
                          "SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rank_{c}" for c in ("c_acctbal", "c_nationkey", "week"))
                          + f" FROM ({CUSTOMER_WEEK}))" for m, v in (("pearson", "%s"), ("spearman", "rank_%s")) for a, b in combinations(["c_acctbal", "c_nationkey", "week"], 2)])
                 + ")")
OLS_P_VALUES = f"""WITH d AS (SELECT c_acctbal, CAST(c_custkey % 7 AS DOUBLE) AS week FROM customer),
s AS ({union([f"SELECT '{y}' AS target, '{x}' AS feature, regr_slope({y}, {x}) AS b, sqrt((regr_syy({y}, {x}) - power(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x})) / (count(*) - 2) / regr_sxx({y}, {x})) AS e, count(*) - 2 AS dof FROM d" for y, x in (("c_acctbal", "week"), ("week", "c_acctbal"))])}),
p AS (SELECT *, {student_p('(b / e)', 'dof')} AS p FROM s)
SELECT target, feature, {r('b', 6)} AS estimate, {r('e', 6)} AS standard_error, {r('b / e', 6)} AS statistic, {r('p', 6)} AS p_value, p < 0.05 AS is_significant FROM p"""
LOGISTIC_GROUPS = f"""WITH d AS (SELECT l_quantity > 25 AS big, l_returnflag = 'R' AS returned, CASE WHEN l_linenumber <> 7 THEN l_discount > 0.05 END AS cheap FROM lineitem),
c AS ({union([f"SELECT '{y}' AS target, CAST(count(*) FILTER (WHERE big AND {y}) AS DOUBLE) AS a, count(*) FILTER (WHERE big AND NOT {y}) AS b, count(*) FILTER (WHERE NOT big AND {y}) AS c, count(*) FILTER (WHERE NOT big AND NOT {y}) AS d FROM d WHERE {y} IS NOT NULL" for y in ("returned", "cheap")])}),
e AS (SELECT *, ln(a * d / (b * c)) AS est, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM c)
SELECT target, CAST(a + b + c + d AS BIGINT) AS n_observations, CAST(a + c AS BIGINT) AS true_count, {r('ln(c / d)', 5)} AS intercept,
 {r('(1 + abs(a / (a + c) - b / (b + d))) / 2', 5)} AS auc, {r('(greatest(a, b) + greatest(c, d)) / (a + b + c + d)', 5)} AS accuracy, true AS converged,
 'big' AS feature, {r('est', 5)} AS estimate, {r('se', 5)} AS standard_error, {r('est / se', 5)} AS statistic, {r('2 * ' + normal_above('abs(est / se)'), 5)} AS p_value, {r('exp(est)', 5)} AS odds_ratio FROM e"""
K_CHOICE = f"""WITH d AS (SELECT c_nationkey % 3 AS g, (c_nationkey % 3) * 100 + c_acctbal / 2000 AS x, CASE WHEN c_nationkey % 3 = 1 THEN 80.0 ELSE 0.0 END + c_custkey % 7 AS y, c_custkey AS id FROM customer),
z AS (SELECT g, id, (x - mx) / sx AS x, (y - my) / sy AS y FROM d, (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM d)),
m AS (SELECT g, avg(x) AS x, avg(y) AS y FROM z GROUP BY g),
a AS (SELECT z.id, z.g = m.g AS own, sqrt(power(z.x - m.x, 2) + power(z.y - m.y, 2)) AS d FROM z, m),
s AS (SELECT id, min(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b FROM a GROUP BY id)
SELECT CAST(3 AS BIGINT) AS k, {r('avg((b - a) / b)', 6)} AS silhouette, 'centroid' AS metric, count(*) AS n_rows, true AS converged FROM s"""
PROJECTION = f"""WITH z AS (SELECT p_partkey, (p_size - ms) / ss AS a, (p_retailprice - mp) / sp AS b, rho FROM part,
 (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp, corr(p_size, p_retailprice) AS rho FROM part))
SELECT p_partkey, {r('abs(CASE WHEN rho >= 0 THEN a + b ELSE a - b END / sqrt(2))', 6)} AS x, {r('abs(CASE WHEN rho >= 0 THEN a - b ELSE a + b END / sqrt(2))', 6)} AS y FROM z"""
PROJECTION_CELLS = f"""WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, p_partkey % 3 AS cluster FROM part),
e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM d)
SELECT cluster, {r('avg(x)')} AS x, {r('avg(y)')} AS y, count(*) AS n FROM d, e
GROUP BY cluster, least(floor((x - lx) / (hx - lx) * 50), 49), least(floor((y - ly) / (hy - ly) * 50), 49)"""
TIED_LEADERS = union([f"""WITH c AS (SELECT {e} AS v, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT count(*) AS k, max(n) AS top, sum(n) AS total FROM c),
t AS (SELECT count(*) AS tied FROM c, a WHERE (top - n) * 1.0 / total < 0.0005)
SELECT '{name}' AS name, k AS unique_count, top AS mode_frequency, tied AS tied_count, CASE WHEN k <= 2 THEN 'two_state' WHEN tied >= 2 THEN 'tied_lead' ELSE 'leader' END AS rule FROM a, t"""
    for name, e in (("shift", "o_orderkey % 8"), ("half", "CASE WHEN o_orderkey % 8 < 2 THEN 'a' ELSE 'b' END"), ("o_orderpriority", "o_orderpriority"))])

ORACLES: dict[str, str] = {
    "profile_numeric_orders": numeric_profile("orders", ["o_totalprice"]),
    "profile_numeric_lineitem": numeric_profile("lineitem", LINEITEM),
    "profile_numeric_customer": numeric_profile("customer", ["c_acctbal"]),
    "profile_numeric_documents": numeric_profile("documents", ["n_chars"]),
    "gini": gini([("customer", "c_acctbal"), ("orders", "o_totalprice")]),
    "histogram": union([rounded_histogram(histogram("lineitem", "l_extendedprice")),
                        rounded_histogram(histogram("part", "p_size", "whole AND n = total_rows"))]),
    "histogram_bars": f"SELECT name, bin, {r('(bin_lo + bin_hi) / 2')} AS center, {r('bin_hi - bin_lo')} AS width, cnt FROM ({histogram('orders', 'o_totalprice')})",
    "outliers_top50": OUTLIERS,
    "year_hint": YEARS,
    "profile_categorical": categorical([("orders", "o_orderpriority"), ("orders", "o_orderstatus"), ("events", "event_type"), ("conversations", "role")]),
    "top_values": top_values([("lineitem", "l_returnflag"), ("part", "p_brand"), ("part", "p_type")]),
    "profile_boolean": boolean([("quality", "CASE WHEN quality = 1 THEN 'yes' ELSE 'No' END"),
                                ("toxic", "CASE WHEN doc_id % 11 = 0 THEN '?' ELSE CAST(toxic AS VARCHAR) END")]),
    "profile_datetime": datetimes([("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate")]),
    "missing_report": missing_report(),
    "unknown_columns": "SELECT 'empty' AS name, count(*) AS total_rows, count(*) AS missing, 'No numeric values after coercion.' AS reason FROM orders "
                       "UNION ALL SELECT 'priority', count(*), count(*) FILTER (WHERE o_orderpriority IS NULL), 'No recognized boolean values.' FROM orders",
    "columns_by_kind": "SELECT * FROM (VALUES (0, 'numeric', 0, 'o_orderkey'), (0, 'numeric', 1, 'o_custkey'), (1, 'categorical', 2, 'o_orderstatus'), "
                       "(0, 'numeric', 3, 'o_totalprice'), (2, 'datetime', 4, 'o_orderdate'), (1, 'categorical', 5, 'o_orderpriority')) t(kind_rank, kind, position, name)",
    "infer_kinds": infer_kinds(),
    "normalize_missing": f"SELECT k, {clean('price')} AS price, {clean('amount')} AS amount, {clean('day')} AS day, {clean('empty')} AS empty FROM ({DIRTY})",
    "coerce_numeric": f"SELECT k, {r(to_number('price'), 2)} AS price, {r(to_number('amount'), 2)} AS amount FROM ({DIRTY})",
    "coerce_datetime": f"SELECT k, strftime(CAST(try_strptime(day, '%Y-%m-%d') AS TIMESTAMP), {STAMP}) AS day FROM ({DIRTY})",
    "coerce_boolean": f"SELECT k, CASE WHEN lower(flag) IN {TRUE} THEN 'true' WHEN lower(flag) IN {FALSE} THEN 'false' END AS flag FROM ({DIRTY})",
    "scrub_non_finite": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders",
    "preview": TEXT_PREVIEW,
    "malformed_rows": MALFORMED,
    "distributed_rank": "SELECT o_totalprice AS value, count(*) AS cnt, CAST(sum(count(*)) OVER (ORDER BY o_totalprice) - count(*) AS BIGINT) AS before, "
                        "sum(count(*)) OVER (ORDER BY o_totalprice) - count(*) + (count(*) + 1) / 2.0 AS avg_rank FROM orders GROUP BY 1",
    "exact_median": "SELECT count(*) AS n, median(value) AS median FROM events",
    "pearson_pairs": pearson(LINEITEM, "lineitem".join(["SELECT * FROM ", ""])),
    "pearson_embeddings": PEARSON_EMBEDDINGS,
    "pair_p_values": PAIR_P_VALUES,
    "ols_p_values": OLS_P_VALUES,
    "logistic_groups": LOGISTIC_GROUPS,
    "k_choice": K_CHOICE,
    "projection": PROJECTION,
    "projection_cells": PROJECTION_CELLS,
    "tied_leaders": TIED_LEADERS,
    "read_files": READ_FILES,
    "normality": normality([*[("lineitem", c) for c in LINEITEM], ("supplier", "s_acctbal")]),
    "spearman_pairs": spearman(LINEITEM, "SELECT * FROM lineitem"),
    "pairs_with_gaps": union([pearson(["a", "b", "c"], GAPPY, method="pearson"), spearman(["a", "b", "c"], GAPPY, method="spearman")]),
    "pair_records": PAIR_RECORDS,
    "top_pairs": TOP_PAIRS,
    "ols_simple": ols_simple(),
    "ols_full": OLS_FULL,
    "vif": VIF,
    "auc_accuracy": AUC,
    "zscore": ZSCORE,
    "pca_variance": PCA_VARIANCE,
    "silhouette_squared_given": SILHOUETTE,
    "cluster_summary": cluster_summary(),
    "trend_fit": TREND_FIT,
    "forecast": FORECAST,
    "trend_anchors": ANCHORS,
    "trend_history": HISTORY,
    "series_gate": series_gate([("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]),
    "findings_numeric": numeric_findings([*[("lineitem", c) for c in LINEITEM], ("events", "value"), ("customer", "c_acctbal")]),
    "findings_categorical": categorical_findings([("p_name", "p_name"), ("p_brand", "p_brand"), ("bulk", "CASE WHEN p_size > 5 THEN 'big' ELSE 'small' END")]),
    "findings_pairs": PAIR_FINDINGS,
    "findings_models": MODEL_FINDINGS,
    "findings_trend": TREND_FINDINGS,
    "findings_booleans": BOOLEAN_FINDINGS,
    "cell_formats": FORMATS,
}
