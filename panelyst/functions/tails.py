"""Upper-tail probabilities of the chi-square, F and normal distributions.

Spark SQL has no distribution functions. These run on finished test
statistics (one row per test), never on the data, as Arrow-batched helpers.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelyst.functions.nulls import as_col

# Ship these small functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
# A continued fraction ends when a step changes it by less than this share, or is an error.
_CLOSE, _STEPS = 1e-15, 100_000


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = d * c
        h *= step
        if abs(step - 1) < _CLOSE:
            return scale * h
    raise ArithmeticError(f"no value for the tail of chi-square after {_STEPS} steps")


def _beta_fraction(a: float, b: float, x: float) -> float:
    c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, _STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < _CLOSE:
            return h
    raise ArithmeticError(f"no value for the tail of F after {_STEPS} steps")


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def f_tail(f: float, df1: float, df2: float) -> float:
    return beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _apply(fn, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype("float64") for s in series])
    return pd.Series([None if any(v != v for v in r) else fn(*r) for r in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(chi2_tail, x, df)


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _apply(f_tail, f, df1, df2)


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return _apply(normal_two_sided, z)


def _null_not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def chi2_p(x: Column | str, df: Column | str) -> Column:
    return _null_not_nan(_chi2_p(as_col(x).cast("double"), as_col(df).cast("double")))


def f_p(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    return _null_not_nan(_f_p(*[as_col(c).cast("double") for c in (f, df1, df2)]))


def normal_p(z: Column | str) -> Column:
    return _null_not_nan(_normal_p(as_col(z).cast("double")))
