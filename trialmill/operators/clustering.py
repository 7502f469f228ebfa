"""Per-class K-Means and silhouettes over vector columns, all classes in one job."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.arrays import let
from ..functions.vectors import dot, squared_distance
from ..session import cut_lineage, forget, small_side
from . import blocks

TILE_ROWS = 2048


def vector_mean(vec: str, dim: int) -> Column:
    """Element-wise mean as `dim` plain averages: combines before the shuffle, nothing is exploded."""
    return F.array(*[F.avg(F.get(F.col(vec), F.lit(i))) for i in range(dim)])


def centroids_of(points: DataFrame, keys: list[str], vec: str, dim: int) -> DataFrame:
    return points.groupBy(*keys).agg(vector_mean(vec, dim).alias("centroid"), F.count("*").alias("n"))


def centroid_distance(points: DataFrame, centroids: DataFrame, keys: list[str], vec: str) -> DataFrame:
    joined = points.join(small_side(centroids.select(*keys, "centroid")), keys)
    return joined.withColumn("distance", F.sqrt(squared_distance(F.col(vec), F.col("centroid")))).drop("centroid")


def _packed(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """All centroids of a class (and restart) in one array: k entries."""
    return centroids.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_centroids"))


def assign(points: DataFrame, centroids: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Nearest centroid of the point's class; equal distances go to the lower cluster."""
    joined = points.join(small_side(_packed(centroids, keys)), [k for k in keys if k in points.columns])
    nearest = F.array_min(F.transform("_centroids", lambda c: F.struct(
        squared_distance(F.col(vec), c["centroid"]).alias("d2"), c["cluster"].alias("cluster"))))
    return joined.withColumn("_near", nearest).withColumns({
        "cluster": F.col("_near.cluster"), "d2": F.col("_near.d2")}).drop("_near", "_centroids")


def lloyd_step(points: DataFrame, centroids: DataFrame, keys: list[str], vec: str, dim: int) -> DataFrame:
    """One assign-and-update round: new centroids with their size and inertia."""
    assigned = assign(points, centroids, keys, vec)
    return assigned.groupBy(*keys, "cluster").agg(
        vector_mean(vec, dim).alias("centroid"), F.count("*").alias("n"), F.sum("d2").alias("inertia"))


def _refilled(points: DataFrame, before: DataFrame, moved: DataFrame, keys: list[str], point: str, vec: str) -> DataFrame:
    """`moved` with one lost cluster per class and restart put on the point farthest from its centroid.

    Further lost clusters stay where they were.
    """
    gone = before.join(moved.select(*keys, "cluster"), keys + ["cluster"], "left_anti").select(*keys, "cluster", "centroid")
    lost = gone.groupBy(*keys).agg(F.min("cluster").alias("cluster"))
    far = assign(points.join(small_side(lost.select(*keys)), keys), before, keys, vec).groupBy(*keys).agg(
        F.max_by(vec, F.struct("d2", point)).alias("centroid"))
    added = lost.join(far, keys).select(*keys, "cluster", "centroid")
    waiting = gone.join(lost, keys + ["cluster"], "left_anti")
    return moved.select(*keys, "cluster", "centroid").unionByName(added).unionByName(waiting)


def _each_centroid(state: DataFrame) -> DataFrame:
    return state.select("label", "restart", F.posexplode("c").alias("cluster", "centroid"))


def _moved_on(points: DataFrame, large: DataFrame, state: DataFrame, dim: int, rounds: int, tolerance: float) -> DataFrame:
    """Runs (label, restart, c) moved until each has settled; a round is one pass over the blocks of those that move.

    Runs are written out between rounds.  `points` (label, point, vec) are read where a cluster lost its points.
    """
    keys = ["label", "restart"]
    state = state.select(*keys, "c", F.lit(True).alias("moving"), F.lit(0.0).alias("inertia"),
                         F.array().cast("array<int>").alias("lost"))
    least, stale = math.inf, 0
    while True:
        active = state.filter("moving").select(*keys, "c")
        moved = blocks.moved_runs(large, active, dim).join(F.broadcast(active), keys).select(
            *keys, F.col("c").alias("before"), "inertia",
            F.zip_with("c", "means", lambda old, m: F.zip_with(old, m["mean"], lambda x, y: F.coalesce(y, x))).alias("c"),
            F.transform(F.filter("means", lambda m: m["n"] == 0), lambda m: m["cluster"]).alias("lost"))
        shift = F.array_max(F.zip_with("before", "c", squared_distance))
        rounding = blocks.ROUNDING * F.array_max(F.transform("c", lambda c: dot(c, c)))
        judged = moved.withColumn(
            "moving", (F.size("lost") > 0) | (shift > F.greatest(F.lit(float(tolerance ** 2)), rounding)))
        seen = Observation()
        written = cut_lineage(state.filter("not moving").unionByName(judged.select(*state.columns)).observe(
            seen, F.count_if("moving").alias("moving"), F.sum("inertia").alias("inertia"), F.sum(F.size("lost")).alias("lost")))
        if seen.get["lost"]:
            short = written.filter("moving and size(lost) > 0")
            before = active.join(F.broadcast(short.select(*keys)), keys)
            kept = _each_centroid(short).join(
                short.select(*keys, F.explode("lost").alias("cluster")), [*keys, "cluster"], "left_anti")
            fanned = points.join(small_side(short.select(*keys)), "label")
            filled = _refilled(fanned, _each_centroid(before), kept, keys, "point", "vec").groupBy(*keys).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))), lambda s: s["centroid"]).alias("filled"))
            whole = written.join(filled, keys, "left").withColumn("c", F.coalesce("filled", "c")).withColumn(
                "lost", F.array().cast("array<int>")).select(*state.columns)
            whole = cut_lineage(whole)
            forget(written)
            written = whole
        forget(state)
        state = written
        least, stale = blocks.progress(seen.get["inertia"], least, stale, rounds)
        if not seen.get["moving"]:
            return state.select(*keys, "c")


def _settled_together(points: DataFrame, large: DataFrame, sizes: DataFrame, dim: int, k: int, restarts: int, rounds: int,
                      tolerance: float) -> DataFrame:
    """(label, cluster, centroid) of classes that no task holds: k-means++ in a pass a centroid, then common rounds."""
    keys = ["label", "restart"]
    tries = F.explode(F.array(*[F.lit(r) for r in range(restarts)]))
    state = sizes.filter("not whole").select("label", tries.alias("restart"), F.array().cast("array<array<double>>").alias("c"))
    for step in range(k):
        drawn = state.join(blocks.winners(large, state, dim, step), keys, "left").select(
            *keys, F.when(F.col("won").isNull(), F.col("c")).otherwise(F.concat("c", F.array("won"))).alias("c"))
        state, before = cut_lineage(drawn), state
        forget(before)
    state = _moved_on(points, large, state, dim, rounds, tolerance)
    best = blocks.moved_runs(large, state, dim).groupBy("label").agg(
        F.min_by("restart", F.struct("inertia", "restart")).alias("restart"))
    best = cut_lineage(state.join(small_side(best), keys))
    return _each_centroid(_moved_on(points, large, best, dim, rounds, 0.0)).drop("restart")


def kmeans_per_class(points: DataFrame, label: str, point: str, vec: str, dim: int, k: int = 6, restarts: int = 10,
                     rounds: int = 300, tolerance: float = 1e-4, whole_bytes: int = blocks.WHOLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids) of the best of `restarts` runs per class.

    Points are packed into blocks of their class once.  One task holds a class of up to `whole_bytes` of vectors
    and runs all its restarts; larger classes move together, a round is one pass over their blocks.  Either way a run
    goes on until its centroids settle, and the best one until no point changes its cluster: `rounds` rounds without a
    lower inertia are an error.  A cluster that lost its points starts again at the farthest one.  Clusters are
    numbered by their smallest member, so ids do not depend on seeding.
    """
    sizes = blocks.class_sizes(points, label, dim, whole_bytes)
    packed = blocks.pack(points, sizes, label, point, vec, dim)
    held = sizes.agg(F.count_if("whole").alias("whole"), F.count_if(~F.col("whole")).alias("large")).first()
    cores = points.sparkSession.sparkContext.defaultParallelism
    final = blocks.settle_classes(
        packed, max(1, min(8 * held["whole"], 64 * cores)), dim, k, restarts, rounds, tolerance)
    if held["large"]:
        plain = points.select(F.col(label).alias("label"), F.col(point).alias("point"), F.col(vec).alias("vec"))
        final = final.unionByName(_settled_together(
            plain, packed.filter("not whole"), sizes, dim, k, restarts, rounds, tolerance))
    final = cut_lineage(final.withColumnRenamed("label", label))
    forget(packed, sizes)
    assigned = assign(points, final, [label], vec)
    names = assigned.groupBy(label, "cluster").agg(F.min(point).alias("_first"))
    ranked = names.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_first", "cluster"))).alias("_order"))
    renumber = ranked.select(label, F.posexplode("_order").alias("_new", "_old")).select(
        label, F.col("_old.cluster").alias("cluster"), F.col("_new").alias("_cluster"))
    renumber = cut_lineage(renumber)

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(small_side(renumber), [label, "cluster"]).drop("cluster").withColumnRenamed("_cluster", "cluster")

    return renamed(assigned), renamed(final)


def silhouette_exact(points: DataFrame, label: str, cluster: str, point: str, vec: str, minimum: int = 12,
                     tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean Euclidean silhouette per class, over every pair of a class.

    The distances are inherently quadratic: a class of n points moves n * n / `tile_rows` vectors.
    Points are cut into tiles of bounded size; a task gets two tiles, in one order only, and
    returns, per point of either, the distance sums to each cluster.  Pairs are never emitted
    and a class of any size spreads over many tasks.
    """
    sizes = points.groupBy(label).agg(F.count("*").alias("_total")).filter(F.col("_total") >= minimum)
    tiles = F.greatest(F.lit(1), F.ceil(F.col("_total") / tile_rows)).cast("int")
    tiled = points.join(small_side(sizes), label).select(
        label, F.col(cluster).cast("int").alias("_c"), F.col(point).alias("_p"), F.col(vec).alias("_v"),
        tiles.alias("_tiles"), F.pmod(F.xxhash64(point), tiles).cast("int").alias("_t"))
    left = tiled.withColumn("_j", F.explode(F.sequence(F.col("_t"), F.col("_tiles") - 1))).select(
        label, F.col("_t").alias("_i"), "_j", "_p", "_c", "_v")
    right = tiled.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t")))).select(
        F.col(label).alias("_label"), F.col("_i").alias("_ri"), F.col("_t").alias("_rj"), F.col("_p").alias("_rp"),
        F.col("_c").alias("_rc"), F.col("_v").alias("_rv"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [label, "_p", "_c", "_to", "_sum", "_n"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        x, y = np.stack(a["_v"]).astype(float), np.stack(b["_rv"]).astype(float)
        mine, own = np.unique(a["_c"].to_numpy(), return_inverse=True)
        theirs, other = np.unique(b["_rc"].to_numpy(), return_inverse=True)
        in_mine, in_theirs = np.eye(len(mine))[own], np.eye(len(theirs))[other]
        out, back = np.zeros((len(x), len(theirs))), np.zeros((len(y), len(mine)))
        for start in range(0, len(y), 64):
            gap = x[:, None, :] - y[None, start:start + 64, :]
            far = np.sqrt((gap * gap).sum(axis=2))
            out += far @ in_theirs[start:start + 64]
            back[start:start + 64] = far.T @ in_mine
        parts = [pd.DataFrame({label: a[label], "_p": a["_p"], "_c": a["_c"], "_to": to, "_sum": out[:, i],
                               "_n": int(in_theirs[:, i].sum())}) for i, to in enumerate(theirs)]
        if a["_i"].iloc[0] != a["_j"].iloc[0]:
            parts += [pd.DataFrame({label: b["_label"], "_p": b["_rp"], "_c": b["_rc"], "_to": to, "_sum": back[:, i],
                                    "_n": int(in_mine[:, i].sum())}) for i, to in enumerate(mine)]
        return pd.concat(parts, ignore_index=True)[columns]

    types = {f.name: f.dataType.simpleString() for f in tiled.schema}
    sums = left.groupBy(label, "_i", "_j").cogroup(right.groupBy("_label", "_ri", "_rj")).applyInPandas(
        tile, f"`{label}` {types[label]}, _p {types['_p']}, _c int, _to int, _sum double, _n long")
    per_cluster = sums.groupBy(label, "_p", "_c", "_to").agg(F.sum("_sum").alias("s"), F.sum("_n").alias("n"))
    own, other = F.col("_to") == F.col("_c"), F.col("_to") != F.col("_c")
    per_point = per_cluster.groupBy(label, "_p").agg(
        F.max(F.when(own, F.col("n"))).alias("own_n"),
        F.max(F.when(own, F.try_divide("s", F.col("n") - 1))).alias("a"),
        F.min(F.when(other, F.col("s") / F.col("n"))).alias("b"))
    width = F.when(F.col("own_n") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_point.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(width), 6).alias("silhouette"))


def silhouette_fast(points: DataFrame, label: str, cluster: str, vec: str, dim: int, minimum: int = 12) -> DataFrame:
    """Silhouette under *squared* Euclidean distance, linear in the number of points.

    Mean squared distance to a cluster follows from its size, mean vector and mean squared
    norm, so one aggregate and one small join replace all pairs.  A different number from
    `silhouette_exact`; meant for classes where pairs are out of reach.
    """
    square = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x * x)
    profile = points.groupBy(label, F.col(cluster).alias("_k")).agg(
        F.count("*").alias("n"), vector_mean(vec, dim).alias("m"), F.avg(square).alias("q"))
    packed = profile.groupBy(label).agg(
        F.collect_list(F.struct("_k", "n", "m", "q")).alias("_profiles"), F.sum("n").alias("_total"))
    joined = points.join(small_side(packed.filter(F.col("_total") >= minimum)), label)

    def mean_gap(own_square: Column, p: Column) -> Column:
        return own_square + p["q"] - 2 * F.aggregate(
            F.zip_with(F.col(vec), p["m"], lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    gaps = let(square, lambda s: F.transform("_profiles", lambda p: F.struct(
        p["_k"].alias("k"), p["n"].alias("n"), mean_gap(s, p).alias("d"))))
    measured = joined.withColumn("_gaps", gaps)
    own = F.filter("_gaps", lambda g: g["k"] == F.col(cluster))[0]
    a = F.try_divide(own["d"] * own["n"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_gaps", lambda g: g["k"] != F.col(cluster)), lambda g: g["d"]))
    staged = measured.select(label, own["n"].alias("own_n"), a.alias("a"), b.alias("b"))
    width = F.when(F.col("own_n") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return staged.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(width), 6).alias("silhouette_sq"))
