"""Kendall's tau-b of two columns of any length, without comparing rows pair by pair.

Rows are counted by distinct pair of values.  Both columns are cut into ranges, a frequent value being a
range of its own.  Of two cells in different ranges of both columns the table of range counts tells the
order; cells in one range of the first column are compared in that range's task, the rest in the task of
their range of the second.  A range of one value has only ties and is not visited.

Rows with a null or NaN in either column take no part; tau is null where a column has one value only.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Cells a range should hold; the number of ranges stays below `MOST_RANGES`, so the table of counts is bounded.
CELLS_PER_RANGE, MOST_RANGES = 200_000, 512


def surplus(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Concordant less discordant pairs of weighted cells, by the bits of the first column's ranks."""
    if not len(x):
        return 0
    code, rank = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    total = sum(map(int, w)) if w.dtype == object else int(w.sum())
    w = w.astype(object if total >= 2 ** 31 else np.int64)  # products of sums fit 64 bits, or are Python's
    found = 0
    for bit in range(int(code.max()).bit_length()):
        # cells that agree above this bit and differ in it are ordered by it
        group = code >> (bit + 1)
        order = np.lexsort((rank, group))
        g, r, ones, weight = group[order], rank[order], (code[order] >> bit & 1).astype(bool), w[order]
        zeros = np.concatenate(([0], np.cumsum(np.where(ones, 0, weight))))
        fresh_group = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        fresh_tie = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]))))
        at = np.arange(len(g))
        ends = lambda starts: np.concatenate((starts[1:], [len(g)]))
        in_group, in_tie = (np.searchsorted(s, at, "right") - 1 for s in (fresh_group, fresh_tie))
        below = zeros[fresh_tie[in_tie]] - zeros[fresh_group[in_group]]
        above = zeros[ends(fresh_group)[in_group]] - zeros[ends(fresh_tie)[in_tie]]
        found += int(sum((weight * (below - above))[ones].tolist()))
    return found


def _range(value: Column, cuts: list[float]) -> Column:
    """An odd number for a cut itself, an even one for what lies between two."""
    if not cuts:
        return F.lit(0)
    edges = F.lit(cuts)
    below = F.size(F.filter(edges, lambda c: c < value))
    return (2 * below + F.array_contains(edges, value).cast("int")).cast("int")


def _apart(table: np.ndarray) -> int:
    """Surplus of pairs in different ranges of both columns."""
    found, left = 0, [0] * table.shape[1]
    for row in table:
        if any(row):
            total, below = sum(left), 0
            for j, n in enumerate(row):
                found += n * (2 * below + left[j] - total)  # all below less all above
                below += left[j]
            left = [a + b for a, b in zip(left, row)]
    return found


def _pairs(n: Column) -> Column:
    n = n.cast("decimal(19,0)")
    return (n * (n - 1) / 2).cast("decimal(38,0)")


def column_kendall_tau(df: DataFrame, x: str, y: str, ranges: int | None = None) -> DataFrame:
    """One row: n, ties_x, ties_y (tied pairs), surplus (concordant less discordant pairs) and tau_b."""
    pair = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pair = pair.where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    cells = cut_lineage(pair.groupBy("_x", "_y").agg(F.count("*").alias("_n")))
    if ranges is None:
        ranges = min(MOST_RANGES, max(16, math.ceil(cells.count() / CELLS_PER_RANGE)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = [sorted(set(c)) for c in cells.approxQuantile(["_x", "_y"], steps, 0.1 / ranges)] if steps else [[], []]
    placed = cells.select("*", _range(F.col("_x"), cuts[0]).alias("_i"), _range(F.col("_y"), cuts[1]).alias("_j"))
    counts = placed.groupBy("_i", "_j").agg(F.sum("_n").alias("_n")).collect()  # (2 * ranges)^2 rows at most
    table = np.zeros([2 * len(c) + 1 for c in cuts], object)
    for r in counts:
        table[r["_i"], r["_j"]] = r["_n"]

    def within(columns: list[str]):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            a, b = (part[c].to_numpy() for c in columns)
            return pd.DataFrame({"_s": [Decimal(surplus(a, b, part["_n"].to_numpy()))]})
        return run

    inner = placed.where("_i % 2 = 0").groupBy("_i").applyInPandas(within(["_x", "_y"]), "_s decimal(38,0)")
    # of cells in one range of y, only pairs from different ranges of x are still to be compared
    across = placed.where("_j % 2 = 0").groupBy("_j", "_i", "_y").agg(F.sum("_n").alias("_n"))
    across = across.groupBy("_j").applyInPandas(within(["_i", "_y"]), "_s decimal(38,0)")
    apart = Decimal(_apart(table))
    ties = lambda c, name: cells.groupBy(c).agg(F.sum("_n").alias("_n")).agg(
        F.coalesce(F.sum(_pairs(F.col("_n"))), F.lit(0)).cast("decimal(38,0)").alias(name))
    total = (F.coalesce(F.sum("_s"), F.lit(0)) + F.lit(apart)).cast("decimal(38,0)")
    one = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    for part in (ties("_x", "ties_x"), ties("_y", "ties_y"), inner.union(across).agg(total.alias("surplus"))):
        one = one.crossJoin(part)  # one row each
    every = _pairs(F.col("n")).cast("double")
    scale = F.sqrt(every - F.col("ties_x").cast("double")) * F.sqrt(every - F.col("ties_y").cast("double"))
    return one.withColumn("tau_b", F.when(scale > 0, F.col("surplus").cast("double") / scale))
