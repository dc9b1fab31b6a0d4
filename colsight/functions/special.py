"""Distribution tails.

The normal tail is a Column expression (Cody's rational approximations of the
error function, accurate to double precision), so it runs inside code
generation even over billions of values. Student's t is only needed on result
rows (one per pair or coefficient) and is an Arrow pandas UDF.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: Cody (1969) coefficients, highest power first -------------
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02,
           3.77485237685302021e02, 3.20937758913846947e03)
ERF_DEN = (1.0, 2.36012909523441209e01, 2.44024637934444173e02,
           1.28261652607737228e03, 2.84423683343917062e03)
MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00,
           6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
           1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03)
MID_DEN = (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
           1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
           3.43936767414372164e03, 1.23033935480374942e03)
FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
           1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_DEN = (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
           6.05183413131244913e-2, 2.33520497626869185e-3)
# --- end of fixed values -----------------------------------------------------


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _log_erfc(x: Column) -> Column:
    """ln(erfc(x)) for x >= 0; stays finite far beyond where erfc underflows."""
    sq = x * x
    near = F.log1p(-(x * _horner(sq, ERF_NUM) / _horner(sq, ERF_DEN)))
    mid = F.log(_horner(x, MID_NUM) / _horner(x, MID_DEN)) - sq
    inv = F.lit(1.0) / F.greatest(sq, F.lit(1.0))
    tail = inv * _horner(inv, FAR_NUM) / _horner(inv, FAR_DEN)
    far = F.log((F.lit(1.0 / math.sqrt(math.pi)) - tail) / F.greatest(x, F.lit(1.0))) - sq
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).otherwise(far)


def log_far_tail(z: Column) -> Column:
    """ln P(Z > |z|): the smaller of the two tails."""
    return F.lit(math.log(0.5)) + _log_erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def log_near_tail(far: Column) -> Column:
    """ln P(Z <= |z|) from ``far`` = ln P(Z > |z|)."""
    return F.log1p(-F.exp(far))


def normal_two_sided_p(z: Column) -> Column:
    return F.exp(_log_erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


# ----- Student's t on result rows --------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) of Student's t distribution; NaN when it is undefined."""
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if dof > 1e8:
        return math.erfc(abs(t) / math.sqrt(2.0))
    sq = t * t
    x, y = dof / (dof + sq), sq / (dof + sq)
    if y == 0.0:
        return 1.0
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * (math.log(x) if x > 0.5 and y > 1e-8 else -math.log1p(sq / dof)) + b * math.log(y)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, y) / b)


def _t_batch(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


def t_two_sided_p_col(t: Column, dof: Column) -> Column:
    """Student-t tail as a column; for result rows (pairs, coefficients), not data rows."""
    batch = F.pandas_udf(_t_batch, T.DoubleType())
    return F.nanvl(batch(t, dof.cast("double")), F.lit(None).cast("double"))


# ----- Shapiro-Francia -------------------------------------------------------

# --- fixed values: Acklam's normal quantile, highest power first; Royston (1993) --
QUANTILE_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
                1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                6.680131188771972e+01, -1.328068155288572e+01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL_FROM = 0.02425
FRANCIA_MEAN = (-1.2725, 1.0521)
FRANCIA_SD = (1.0308, -0.26758)
SCORE_SHIFTS = (0.375, 0.25)
# --- end of fixed values -----------------------------------------------------


def normal_quantile(p: Column, rest: Column) -> Column:
    """z with P(Z <= z) = p, to about nine digits; ``rest`` is 1 - p, given apart so that neither tail loses digits."""
    middle = p - F.lit(0.5)
    square = middle * middle
    centre = middle * _horner(square, QUANTILE_NUM) / _horner(square, QUANTILE_DEN)
    far = F.sqrt(F.lit(-2.0) * F.log(F.least(p, rest)))
    tail = _horner(far, TAIL_NUM) / _horner(far, TAIL_DEN)
    return F.when(p < TAIL_FROM, tail).when(rest < TAIL_FROM, -tail).otherwise(centre)


def normal_score(rank: Column, n: Column) -> Column:
    """The expected place of a rank among n normal values; tied values share their mean rank."""
    shift, more = SCORE_SHIFTS
    return normal_quantile((rank - shift) / (n + more), (n - rank + (shift + more)) / (n + more))


def francia_z(w: float, n: int) -> float:
    """W' on a normal scale: large values speak against a normal sample. The fit was made for 5 to 5000 rows and is carried
    on beyond."""
    u = math.log(n)
    v = math.log(u)
    return (math.log(max(1.0 - w, 1e-300)) - FRANCIA_MEAN[0] - FRANCIA_MEAN[1] * (v - u)) / (FRANCIA_SD[0] + FRANCIA_SD[1] * (v + 2.0 / u))


def francia_p(w: float, n: int) -> float:
    return 0.5 * math.erfc(francia_z(w, n) / math.sqrt(2.0))
