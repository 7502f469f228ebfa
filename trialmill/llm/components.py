"""Connected components of a link table, as joins and aggregates.

Large-star and small-star steps in turn: every node hangs its larger, then its smaller neighbours
on the smallest one it knows, until the table is a set of stars.  A round is two joins with minima
that are aggregated before the shuffle, so a node with many links is no group in memory; each round
is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import cut_lineage
from trialmill.session import forget


def _hang(links: DataFrame, keep: str) -> DataFrame:
    """Links (u, v), both ways -> every v on one side of u hangs on the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    return links.join(least, F.col("u") == F.col("_u")).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links -> (node, root): root is the smallest node of the component; nodes without links are absent."""
    # u > v throughout
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, "v > u").unionByName(
            both.groupBy("u").agg(F.min("v").alias("v")).where("v < u")
        ).where("u <> v").distinct()
        large, before = cut_lineage(large), edges
        small = _hang(large, "v <> m").unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v")
        edges = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        forget(before, large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
