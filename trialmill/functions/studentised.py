"""The studentised range as columns: tail and critical value for any number of groups and degrees of freedom.

The range of `k` normal values over an independent estimate of their spread is a nested integral: over the
logarithm u of the estimate, whose density is a curve of width 1 / sqrt(2 df) about 0, and inside over the greatest of
the values.  Both curves are smooth and fall fast, so plain sums over equal steps are accurate to about 1e-11.
The formulas run on group statistics, which are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .arrays import let
from .distributions import t_critical

GRID = 16  # normal probabilities are tabled at every 1/16
REACH = 9
INNER = 8  # steps a unit in the sum over the greatest value
OUTER = 4  # steps a width in the sum over the estimate of the spread


def _density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _below(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def _literal(rows: list[dict[str, float]]) -> Column:
    """Array of structs as one parsed expression, which folds to a literal."""
    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{name}', {value!r}D" for name, value in row.items()) + ")" for row in rows) + ")")


def _table() -> Column:
    """(place, probability below, density) at equal steps."""
    at = [i / GRID for i in range(-REACH * GRID, REACH * GRID + 1)]
    return _literal([{"x": x, "p": _below(x), "d": _density(x)} for x in at])


def _nodes() -> Column:
    at = [i / INNER for i in range(-8 * INNER, 8 * INNER + 1)]
    return _literal([{"z": x, "weight": _density(x) / INNER, "p": _below(x)} for x in at])


def _normal(x: Column, table: Column) -> Column:
    """Probability below `x` and density, by Taylor's series from the nearest tabled place."""
    def near(t: Column) -> Column:
        def series(g: Column) -> Column:
            c, c2 = t["x"], t["x"] * t["x"]
            terms = g * (1 - g / 2 * (c - g / 3 * (c2 - 1 - g / 4 * (c * (c2 - 3) - g / 5 * (c2 * (c2 - 6) + 3)))))
            return F.struct((t["p"] + t["d"] * terms).alias("p"), F.exp(-x * x / 2).alias("e"))
        return let(x - t["x"], series)

    place = F.greatest(F.lit(0), F.least(F.lit(2 * REACH * GRID), F.round((x + REACH) * GRID).cast("int")))
    nothing = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("e"))
    return F.when(x > 0.5 - REACH, let(F.get(table, place), near)).otherwise(nothing)


def _range_of(w: Column, k: Column, nodes: Column, table: Column) -> Column:
    """(p, slope): chance that `k` normal values lie within `w` of each other, and its derivative."""
    def step(acc: Column, n: Column) -> Column:
        def add(other: Column) -> Column:
            inside = F.greatest(n["p"] - other["p"], F.lit(0.0))
            return F.struct(
                (acc["p"] + n["weight"] * F.pow(inside, k - 1)).alias("p"),
                (acc["slope"] + n["weight"] * other["e"] * F.pow(inside, k - 2)).alias("slope"))
        return let(_normal(n["z"] - w, table), add)

    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("slope"))
    return F.aggregate(nodes, zero, step, lambda acc: F.struct(
        (k * acc["p"]).alias("p"), (k * (k - 1) / math.sqrt(2 * math.pi) * acc["slope"]).alias("slope")))


def _tail_and_slope(q: Column, k: Column, df: Column, nodes: Column, table: Column) -> Column:
    """(p, slope): P(Q > q) and minus its derivative."""
    first = F.floor(-OUTER * (8 + 42 / F.sqrt(df))).cast("int")

    def step(acc: Column, i: Column) -> Column:
        def at(u: Column) -> Column:
            def add(r: Column) -> Column:
                return let(F.exp(-df / 2 * (F.expm1(2 * u) - 2 * u)), lambda height: F.struct(
                    (acc["mass"] + height).alias("mass"), (acc["p"] + height * r["p"]).alias("p"),
                    (acc["slope"] + height * F.exp(u) * r["slope"]).alias("slope")))
            return let(_range_of(q * F.exp(u), k, nodes, table), add)
        return let(i / F.lit(float(OUTER)) / F.sqrt(2 * df), at)

    zero = F.struct(*[F.lit(0.0).alias(name) for name in ("mass", "p", "slope")])
    return F.aggregate(F.sequence(first, F.lit(8 * OUTER)), zero, step, lambda acc: F.struct(
        F.greatest(1 - acc["p"] / acc["mass"], F.lit(0.0)).alias("p"), (acc["slope"] / acc["mass"]).alias("slope")))


def _usable(k: Column, df: Column) -> Column:
    return (k >= 2) & (df >= 1)


def range_tail(q: Column, k: Column, df: Column) -> Column:
    """P(Q > q) for the studentised range of `k` groups.  NULL for fewer than two groups or df < 1."""
    q, k, df = (c.cast("double") for c in (q, k, df))
    tail = let(_table(), lambda table: let(_nodes(), lambda nodes: _tail_and_slope(q, k, df, nodes, table)["p"]))
    return F.when(_usable(k, df) & q.isNotNull(), F.least(tail, F.lit(1.0)))


def range_critical(k: Column, df: Column, alpha: float = 0.05) -> Column:
    """The q that the studentised range exceeds with a chance of `alpha`.

    Newton steps on the logarithm of the tail against log q.  They start at the bound that the sum over all
    pairs gives, which lies above the root; the curve is concave, so they come down to it.
    """
    k, df = k.cast("double"), df.cast("double")

    def newton(x: Column, nodes: Column, table: Column) -> Column:
        return let(F.exp(x), lambda q: let(_tail_and_slope(q, k, df, nodes, table), lambda t: F.when(
            t["p"] > 0, x + (F.log(t["p"]) - math.log(alpha)) * t["p"] / (q * t["slope"])).otherwise(x - 0.5)))

    start = F.log(math.sqrt(2) * t_critical(df, 1 - F.lit(2 * alpha) / (k * (k - 1))))
    root = let(_table(), lambda table: let(_nodes(), lambda nodes: F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), start, lambda x, i: newton(x, nodes, table))))
    return F.when(_usable(k, df), F.exp(root))
