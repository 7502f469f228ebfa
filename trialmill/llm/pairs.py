"""Classes of alike points from shared keys: pivots first, then what is left of each key in tiles.

Points meet where they share a key.  In each of `turns` rounds every key has one pivot, a point is compared with at
most one pivot of another class, and links are contracted to their smallest point; a large group of near
copies folds so with a comparison a point.  What still holds several classes is compared whole: the rows of
a key go through in tiles of at most `TILE` by `TILE` points, and a tile gives a spanning forest of its links.

So no pair that shares a key is passed over but those that are connected already, no pair is ever a row,
and a key of any size is split over tasks.  Pivots come from minima that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import cut_lineage
from trialmill.llm.components import connected_components
from trialmill.session import forget

TURNS = 1
TILE = 1024


def shared_keys(rows: DataFrame) -> DataFrame:
    """(point, key) -> (key, point) of keys with two or more points."""
    ends = rows.groupBy("key").agg(F.min("point").alias("_least"), F.max("point").alias("_most")).where("_least <> _most")
    return cut_lineage(rows.join(ends.select("key"), "key", "left_semi").distinct())


def _compose(named: DataFrame | None, roots: DataFrame) -> DataFrame:
    """(node, root) of all points linked so far, after a round's (node, root) of their labels."""
    if named is None:
        return roots
    step = roots.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
    older = named.join(step, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    newer = roots.join(named.select(F.col("node").alias("_had")), F.col("node") == F.col("_had"), "left_anti")
    return cut_lineage(older.unionByName(newer.select("node", "root")))


def _nearest(left: DataFrame, turn: int) -> DataFrame:
    """(a, la, b, lb): each point with one pivot of its keys that is in another class, that of the smallest label."""
    ordered = F.struct("label", F.xxhash64("point", F.lit(turn)).alias("mix"), "point")
    heads = left.groupBy("key").agg(F.min(ordered).alias("_pivot"))
    met = left.join(heads, "key").where(F.col("label") != F.col("_pivot.label"))
    best = met.groupBy("point").agg(F.min("_pivot").alias("_pivot"), F.first("label").alias("lb"))
    return best.select(F.col("_pivot.point").alias("a"), F.col("_pivot.label").alias("la"), F.col("point").alias("b"), "lb")


def _contract(left: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, point, label, n) under new labels, of keys that still hold several; n counts the rows of the key."""
    step = roots.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
    moved = left.join(step, F.col("label") == F.col("_at"), "left").select("key", "point", F.coalesce("_to", "label").alias("label"))
    ends = moved.groupBy("key").agg(F.min("label").alias("_least"), F.max("label").alias("_most"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(moved.join(ends.where("_least <> _most").select("key", "n"), "key"))


def tiles(left: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, one, two, block, point, label): the rows of a key, once for each pair of its blocks."""
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    block = F.pmod(F.xxhash64("point"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rows = left.select("key", "point", "label", block.alias("block"), other)
    return rows.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "point", "label")


def classes(
    rows: DataFrame, alike: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], turns: int = TURNS, tile: int = TILE,
) -> DataFrame:
    """(point, key) -> (node, root) of points alike to another.

    `alike` filters pairs (a, la, b, lb); `finish` gives the links (la, lb) of tiles.
    """
    left = shared_keys(rows).withColumn("label", F.col("point"))
    named = None
    for turn in range(turns + 1):
        links = alike(_nearest(left, turn)) if turn < turns else finish(tiles(left, tile))
        found = cut_lineage(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        roots = cut_lineage(connected_components(found))
        named, before = _compose(named, roots), named
        if turn == turns:
            forget(left, found, before)
            return named
        left, owner = _contract(left, roots), left
        forget(owner, found, before, roots if named is not roots else None)
        if not left.take(1):
            forget(left)
            return named
