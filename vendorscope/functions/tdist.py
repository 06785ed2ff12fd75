"""Student t distribution: CDF tail and quantile.

Only ever applied to the one- or two-row results of the statistics
aggregates (confidence interval, Welch test), through Arrow-batched pandas
UDFs. The math is the regularised incomplete beta function evaluated by its
continued fraction (modified Lentz), and bisection for the inverse. Above
``LARGE_DOF`` degrees of freedom the distribution is the normal one with the
first two corrections in 1/dof (error below 1e-15 there), where the beta
function's logarithms would cancel.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Functions of this module run inside Python workers (Arrow UDF): pickle
# them by value, so executors need only pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FPMIN = 1e-300
_EPS = 3e-16
_MAXIT = 200_000
LARGE_DOF = 1e6


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
    h = d
    for m in range(1, _MAXIT + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
        c = 1.0 + aa / c
        c = c if abs(c) > _FPMIN else _FPMIN
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
        c = 1.0 + aa / c
        c = c if abs(c) > _FPMIN else _FPMIN
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"incomplete beta: no convergence for a={a!r}, b={b!r}, x={x!r}")


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_cf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) = 2 F(-|t|), computed from the tail directly so tiny
    p-values do not underflow to 0 as 2(1 - F(|t|)) would."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > LARGE_DOF:
        return _large_dof_tail(abs(t), df)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def _large_dof_tail(t: float, df: float) -> float:
    """Two-sided tail: the normal one plus terms in 1/df and 1/df^2."""
    if math.isinf(df):
        return math.erfc(t / math.sqrt(2.0))
    pdf = math.exp(-0.5 * t * t) / math.sqrt(2.0 * math.pi)
    first = t * (t * t + 1.0) / 4.0
    second = t * (3.0 * t ** 6 - 7.0 * t ** 4 - 5.0 * t * t - 3.0) / 96.0
    return math.erfc(t / math.sqrt(2.0)) + 2.0 * pdf * (first / df + second / (df * df))


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * t_two_sided_p(t, df)
    return tail if t < 0 else 1.0 - tail


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student t with ``df`` degrees of freedom."""
    if p is None or df is None or math.isnan(p) or math.isnan(df) or df <= 0 or not 0 < p < 1:
        return float("nan")
    if p == 0.5:
        return 0.0
    upper = p > 0.5
    tail = (1.0 - p) if upper else p          # P(T > t) for the |t| sought
    lo, hi = 0.0, 1.0
    while 0.5 * t_two_sided_p(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid == lo or mid == hi:
            break
        if 0.5 * t_two_sided_p(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    t = 0.5 * (lo + hi)
    return t if upper else -t


@F.pandas_udf(DoubleType())
def t_ppf_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, df)], dtype="float64")
