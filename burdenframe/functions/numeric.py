"""Numeric expressions shared by the statistical tests."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

# The fit of erfc: pieces of equal width in t = 2 / (2 + x), a polynomial of this degree on each.
ERFC_PIECES, ERFC_DEGREE = 16, 13


def _scaled_erfc(x: float) -> float:
    """``exp(x*x) * erfc(x)`` for ``x >= 0``: the library's erfc for small x, a continued fraction beyond."""
    if x < 2:
        return math.exp(x * x) * math.erfc(x)
    below = x
    for k in range(300, 0, -1):
        below = x + k / 2 / below
    return 1 / (below * math.sqrt(math.pi))


@cache
def erfc_fit() -> tuple[tuple[float, ...], ...]:
    """Per piece the coefficients of ``exp(x*x) * erfc(x) / t`` in the offset from its middle, -1 to 1, lowest power first.

    They come from interpolation at the Chebyshev points; the error of erfc is below 1e-13 of its value.
    """
    rows = []
    for piece in range(ERFC_PIECES):
        def value(u, piece=piece):
            t = (piece + (u + 1) / 2) / ERFC_PIECES
            return np.array([_scaled_erfc(2 / v - 2) / v for v in t])

        rows.append(tuple(chebyshev.cheb2poly(chebyshev.chebinterpolate(value, ERFC_DEGREE)).tolist()))
    return tuple(rows)


# Fixed value: smallest positive double, stands in for a p-value of zero before taking logarithms.
TINY = 4.9e-324


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it.

    Filters on a column computed by a long formula are pushed below it, formula included; without
    the binding its repeated parts would multiply at every nesting.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def erfc_nonneg(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    fit = F.array(*[F.array(*map(F.lit, row)) for row in erfc_fit()])

    def on_piece(row: Column, u: Column) -> Column:
        terms = [F.get(row, F.lit(k)) for k in range(ERFC_DEGREE + 1)]
        return reduce(lambda acc, c: c + u * acc, reversed(terms[:-1]), terms[-1])

    def of_t(v: Column, t: Column) -> Column:
        piece = F.least(F.floor(t * ERFC_PIECES), F.lit(ERFC_PIECES - 1)).cast("int")
        value = let(piece, lambda k: let(F.get(fit, k), lambda row: let((t * ERFC_PIECES - k) * 2 - 1, lambda u: on_piece(row, u))))
        return t * value * F.exp(-v * v)

    return let(x, lambda v: let(2.0 / (2.0 + v), lambda t: of_t(v, t)))


def two_sided_p(z: Column) -> Column:
    """Two-tailed p-value of a standard normal statistic."""
    return erfc_nonneg(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_1df_p(x: Column) -> Column:
    """Upper tail of a chi-square variable with one degree of freedom."""
    return erfc_nonneg(F.sqrt(F.greatest(x, F.lit(0.0)) / 2.0))


def neg_log10(p: Column) -> Column:
    """``-log10(p)`` with zero lifted to the smallest double."""
    return -F.log10(F.greatest(p, F.lit(TINY)))


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log2_ratio(top: Column, bottom: Column) -> Column:
    """``log2(top/bottom)``, NULL where the ratio is undefined or not positive."""
    ratio = F.try_divide(top, bottom)
    return F.when(ratio > 0, F.log2(ratio))


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
