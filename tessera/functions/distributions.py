"""Tail probabilities for test statistics: chi-square, Student t, F, normal.

Spark has no distribution functions; test outputs here are one row per test,
so the p-value is a small vectorised helper (pandas UDF) applied to that
result. The regularised incomplete gamma and beta functions use the usual
series and continued-fraction expansions (modified Lentz), to about 1e-12.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_EPS = 1e-15
_TINY = 1e-300
_MAX_IT = 10_000


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x is None or a is None or math.isnan(x) or math.isnan(a) or a <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        ap, s, term = a, 1.0 / a, 1.0 / a
        for _ in range(_MAX_IT):
            ap += 1
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * lead)
    b = x + 1 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, _MAX_IT):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return lead * h


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = 1.0 / (_TINY if abs(d) < _TINY else d)
    h = d
    for m in range(1, _MAX_IT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = 1.0 / (_TINY if abs(d) < _TINY else d)
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = 1.0 / (_TINY if abs(d) < _TINY else d)
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x is None or math.isnan(x) or a <= 0 or b <= 0:
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    bt = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def chisq_sf(x: float, k: float) -> float:
    return gamma_q(k / 2.0, x / 2.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _vec(fn, *series: pd.Series) -> pd.Series:
    out = [fn(*[float(v) if v is not None and not pd.isna(v) else float("nan") for v in vals])
           for vals in zip(*series)]
    return pd.Series(out, dtype="float64")


def _chisq_vec(x: pd.Series, k: pd.Series) -> pd.Series:
    return _vec(chisq_sf, x, k)


def _t_vec(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, df)


def _f_vec(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


def _z_vec(z: pd.Series) -> pd.Series:
    return _vec(normal_two_sided, z)


_UDFS: dict = {}


def _udf(fn):
    # made on first use: a pandas UDF needs an active session to be created
    if fn not in _UDFS:
        _UDFS[fn] = pandas_udf(fn, "double")
    return _UDFS[fn]


def p_chisq(stat, df) -> Column:
    """Upper-tail chi-square probability."""
    return _udf(_chisq_vec)(_c(stat).cast("double"), _c(df).cast("double"))


def p_t(stat, df) -> Column:
    """Two-sided Student t probability."""
    return _udf(_t_vec)(_c(stat).cast("double"), _c(df).cast("double"))


def p_f(stat, df1, df2) -> Column:
    """Upper-tail F probability."""
    return _udf(_f_vec)(_c(stat).cast("double"), _c(df1).cast("double"), _c(df2).cast("double"))


def p_normal(z) -> Column:
    """Two-sided standard normal probability."""
    return _udf(_z_vec)(_c(z).cast("double"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))
