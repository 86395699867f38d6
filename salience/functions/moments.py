"""Statistics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over rows where both are known; NULL where a side does not vary."""
    known = x.isNotNull() & y.isNotNull()
    a, b = F.when(known, x), F.when(known, y)
    flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _cells(x: Column, y: Column, levels: list) -> list[list[Column]]:
    return [[F.count_if((x == F.lit(u)) & (y == F.lit(v))).cast("double") for v in levels] for u in levels]


def _total(items: list[Column]) -> Column:
    out = items[0]
    for i in items[1:]:
        out = out + i
    return out


def kappa(x: Column, y: Column, levels: list) -> Column:
    """Aggregate: Cohen's kappa from the contingency counts; NULL when chance agreement is total or there is no row."""
    t = _cells(x, y, levels)
    n = _total([c for row in t for c in row])
    same = _total([t[i][i] for i in range(len(levels))])
    chance = _total([_total(t[i]) * _total([row[i] for row in t]) for i in range(len(levels))])
    # (same/n - chance/n^2) / (1 - chance/n^2), kept in whole numbers until the last division
    return F.try_divide(same * n - chance, F.nullif(n * n - chance, F.lit(0.0)))


def tau_b(x: Column, y: Column, levels: list) -> Column:
    """Aggregate: Kendall's tau-b of two ordinal columns, from the contingency counts instead of row pairs."""
    t = _cells(x, y, levels)
    k = range(len(levels))
    up = _total([t[i][j] * _total([t[a][b] for a in k for b in k if a > i and b > j]) for i in k for j in k if i < len(levels) - 1 and j < len(levels) - 1])
    down = _total([t[i][j] * _total([t[a][b] for a in k for b in k if a > i and b < j]) for i in k for j in k if i < len(levels) - 1 and j > 0])
    pairs = lambda c: c * (c - 1) / 2
    n0 = pairs(_total([c for row in t for c in row]))
    n1 = _total([pairs(_total(t[i])) for i in k])
    n2 = _total([pairs(_total([row[j] for row in t])) for j in k])
    return F.try_divide(up - down, F.nullif(F.sqrt((n0 - n1) * (n0 - n2)), F.lit(0.0)))
