"""Tail probabilities and quantiles as columns.

Every formula costs a bounded number of steps whatever the degrees of freedom, because
the degrees of freedom grow with the data.  They run on result rows, which are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .arrays import let


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > z): the series about 0 for small z, the continued fraction in the tail."""
    z = F.abs(z)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * z * z / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * z * z / (2 * k + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda acc, k: z + k / acc)
    return F.when(z < 3, 1 - 2 * density * series).otherwise(2 * density / fraction)


def _tail_sum(scale: Column, height) -> Column:
    """Integral of `height` from 0 to infinity; it falls at least exponentially beyond `scale`.

    The points are scale * exp(v - exp(-v)), which crowd towards 0 and thin out in the tail, so the
    plain sum over equal steps of v is accurate to about 1e-13.
    """
    def step(acc: Column, i: Column) -> Column:
        v = i / 32.0
        return let(F.exp(-v), lambda e: let(scale * F.exp(v - e), lambda t: acc + height(t) * t * (1 + e)))

    return F.aggregate(F.sequence(F.lit(-120), F.lit(150)), F.lit(0.0), step) / 32


def _cosh_tail(w: Column, df: Column) -> Column:
    """Integral of cosh(x)^-df from w >= 0 on, divided by cosh(w)^-df."""
    slope = F.tanh(w)
    return let(slope, lambda s: _tail_sum(1 / (df * s + F.sqrt(df)), lambda t: F.exp(
        -df * F.log1p(2 * F.pow(F.sinh(t / 2), 2) + s * F.sinh(t)))))


def _cosh_half(df: Column) -> Column:
    """Integral of cosh(x)^-df from 0 on."""
    return _cosh_tail(F.lit(0.0), df)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > t), one rule for all degrees of freedom.

    With t = sqrt(df) sinh(w) the density becomes cosh(w)^-df; both integrals are sums over fixed
    points that follow the width of the curve.  NULL where df < 1.
    """
    df = df.cast("double")
    t = F.abs(t.cast("double"))
    return F.when(df > 0, F.least(F.lit(1.0), let(
        F.asinh(t / F.sqrt(df)),
        lambda w: F.exp(-df / 2 * F.log1p(t * t / df)) * _cosh_tail(w, df) / _cosh_half(df))))


def t_critical(df: Column, level: float | Column = 0.95) -> Column:
    """Two-sided critical value: Newton steps on the logarithm of the tail.

    The logarithm is concave in w, so the first step lands at or beyond the root and the next ones
    come down to it; twelve steps reach machine precision for every df.  NULL where df < 1.
    """
    df = df.cast("double")
    wanted = F.log(1 - level) if isinstance(level, Column) else math.log(1 - level)

    def newton(w: Column, half: Column) -> Column:
        return let(_cosh_tail(w, df), lambda tail: w + tail * (
            F.log(tail / half) - df * F.log(F.cosh(w)) - wanted))

    root = let(_cosh_half(df), lambda half: F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), F.lit(0.0), lambda w, i: newton(w, half)))
    return F.when(df > 0, F.sqrt(df) * F.sinh(root))


def _gamma_half_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): an expansion far out, carried back by the recurrence."""
    far = a + 30
    inv = 1 / far
    top = F.sqrt(far) * (1 - inv / 8 + inv * inv / 128 + 5 * F.pow(inv, 3) / 1024 - 21 * F.pow(inv, 4) / 32768)
    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), top, lambda acc, i: acc * (a + i) / (a + i + 0.5))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) for whole numerator degrees of freedom, in df1/2 steps."""
    a = df2 / 2
    log_y = -F.log1p(df1 * f / df2)
    y_a = F.exp(a * log_y)
    rest = 1 - F.exp(log_y)
    even_sum = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.greatest(df1.cast("int"), F.lit(1))), lambda i: 2 * i < df1),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * rest * (a + i - 1) / i).alias("term"),
            (acc["total"] + acc["term"] * rest * (a + i - 1) / i).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    first = y_a * F.sqrt(rest) * 2 * _gamma_half_ratio(a) / math.sqrt(math.pi)
    odd_sum = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.greatest(df1.cast("int"), F.lit(1))), lambda i: 2 * i < df1),
        F.struct(first.alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * rest * (a + i - 0.5) / (i + 0.5)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    odd = t_two_sided(F.sqrt(df1 * f), df2) + odd_sum
    return F.when(df1 % 2 == 0, y_a * even_sum).otherwise(F.least(odd, F.lit(1.0)))


def binomial_two_sided_half(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for X ~ Binomial(n, 1/2) and k <= n/2, one rule for every n.

    P(X <= k) is the incomplete beta integral of x^(n-k-1) (1-x)^k up to 1/2.  With x = 1 / (1 + e^-s)
    it is the part below s = 0 of a smooth curve with its top at log(a / b); tail and whole are sums
    over fixed points that follow the curve's width, each taken relative to a height, so nothing
    overflows.
    """
    a, b = (n - k).cast("double"), (k + 1).cast("double")
    width = F.sqrt((a + b) / (a * b))
    # shares of the two sides at the top of the curve
    p, q = a / (a + b), b / (a + b)

    def from_top(d: Column) -> Column:
        return F.exp(-a * F.log1p(q * F.expm1(-d)) - b * F.log1p(p * F.expm1(d)))

    whole = _tail_sum(width, from_top) + _tail_sum(width, lambda t: from_top(-t))
    slope = F.abs(a - b) / 2 + F.sqrt(a + b) / 2
    below = _tail_sum(1 / slope, lambda t: F.exp(
        -a * F.log1p(F.expm1(t) / 2) - b * F.log1p(F.expm1(-t) / 2)))
    # height at s = 0 against the top
    crossing = from_top(-F.log1p((a - b) / b))
    return F.when(b > a, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * crossing * below / whole))
