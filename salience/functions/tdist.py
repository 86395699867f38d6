"""Two-sided p-values of Student's t, for tables of test results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a, b, x, rounds=300):
    """Continued fraction of the incomplete beta function (modified Lentz), over arrays."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds + 1):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return h


def t_two_sided(t, df):
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN where undefined."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    ok = np.isfinite(t) & (df > 0)
    out = np.where(np.isinf(t) & (df > 0), 0.0, np.nan)
    if ok.any():
        tt, n = t[ok], df[ok]
        a, b = n / 2.0, np.full_like(n, 0.5)
        x = n / (n + tt * tt)
        swap = x > (a + 1.0) / (a + b + 2.0)
        aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
        log_beta = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(aa, bb)])
        with np.errstate(divide="ignore"):
            front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - log_beta) / aa
        part = np.where(xx <= 0.0, 0.0, front * _beta_fraction(aa, bb, xx))
        out[ok] = np.where(swap, 1.0 - part, part)
    return out


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
