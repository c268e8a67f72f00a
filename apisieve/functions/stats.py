"""Exact tests as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln x! less Stirling's formula, for x = 0 .. 15; above, a series of four terms is as good.
_SMALL = [0.0, *(math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16))]


def _stirling_error(x: Column) -> Column:
    y = 1 / (x * x)
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - y / 1680) * y) * y) / x
    return F.when(x < len(_SMALL), F.element_at(F.array(*[F.lit(v) for v in _SMALL]), x.cast("int") + 1)).otherwise(series)


def _log_term(k: Column, n: Column) -> Column:
    """ln (C(n, k) / 2^n), by Stirling's formula in the form that loses no digits for large n: nothing of the size of ln n! occurs."""
    a, b, whole = k.cast("double"), (n - k).cast("double"), n.cast("double")
    d = (a - b) / whole
    deviance = whole / 2 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    inside = _stirling_error(whole) - _stirling_error(a) - _stirling_error(b) - deviance + F.log(whole / (2 * math.pi * a * b)) / 2
    return F.when(k == n, -whole * math.log(2)).otherwise(inside)


def fair_coin_p(k: Column, n: Column) -> Column:
    """Twice the probability of k heads or more in n fair tosses (n / 2 <= k <= n, n > 0).

    The first term is C(n, k) / 2^n; each next one multiplies by (n - i) / (i + 1). Terms go on until they are under
    10^-17 of the first, for which the distance from n / 2 and sqrt(n) give the number: some 150,000 at n = 10^9 and k = n / 2, a few
    dozen where one side is clearly commoner.
    """
    k, n = k.cast("long"), n.cast("long")
    far = F.ceil(F.lit(40.0) * n / (2 * (2 * k - n) + 1))  # where the ratio at k alone makes terms vanish
    most = F.least(F.ceil(4.5 * F.sqrt(n.cast("double"))) + 60, far + 1, n - k)
    steps = F.when(most > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))

    def step(s, j):
        t = s["t"] * (n - k - j + 1).cast("double") / (k + j).cast("double")
        return F.struct(t.alias("t"), (s["sum"] + t).alias("sum"))

    return 2 * F.exp(_log_term(k, n)) * F.aggregate(steps, start, step, lambda s: s["sum"])
