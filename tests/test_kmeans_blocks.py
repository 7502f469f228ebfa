"""K-Means on blocks: whole classes in one task and classes in common rounds give the same clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import blocks, clustering

SCHEMA = "id long, label string, vec array<double>"


def unstructured(spark, n=400, dim=8, classes=2):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, f"c{i % classes}", x[i].tolist()) for i in range(n)], SCHEMA).repartition(3), x


def clusters(points, dim, **more):
    assigned, centroids = clustering.kmeans_per_class(points, "label", "id", "vec", dim, **more)
    return {r["id"]: r["cluster"] for r in assigned.collect()}, centroids


def misplaced(x, found, classes=2):
    """Points that do not lie nearest to the mean of their own cluster."""
    wrong = 0
    for c in range(classes):
        own = np.array([found[i] for i in range(c, len(x), classes)])
        mine = x[c::classes]
        means = np.array([mine[own == j].mean(axis=0) for j in range(own.max() + 1)])
        wrong += int((((mine[:, None] - means) ** 2).sum(axis=2).argmin(axis=1) != own).sum())
    return wrong


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 30 * 8 * 8)


@pytest.mark.parametrize("more", [{}, {"whole_bytes": 0}])
def test_no_run_is_cut_by_the_number_of_rounds(spark, small_blocks, more):
    points, x = unstructured(spark)
    found, centroids = clusters(points, 8, k=4, restarts=3, rounds=2, **more)
    assert misplaced(x, found) == 0 and set(found.values()) == {0, 1, 2, 3} and centroids.count() == 8


@pytest.mark.parametrize("more", [{}, {"whole_bytes": 0}])
def test_the_best_run_goes_on_to_its_fixpoint(spark, small_blocks, more):
    points, x = unstructured(spark)
    found, _ = clusters(points, 8, k=4, restarts=2, tolerance=0.5, **more)
    assert misplaced(x, found) == 0


def test_both_ways_give_the_same_clusters(spark, small_blocks):
    points, _ = unstructured(spark)
    whole, _ = clusters(points, 8, k=4, restarts=4)
    assert whole == clusters(points, 8, k=4, restarts=4, whole_bytes=0)[0]
    mixed = points.withColumn("label", F.when(F.col("id") % 40 == 0, F.lit("few")).otherwise(F.col("label")))
    assert clusters(mixed, 8, k=4, restarts=2)[0] == clusters(mixed, 8, k=4, restarts=2, whole_bytes=3000)[0]


def test_rounds_of_whole_classes_write_nothing(spark, monkeypatch):
    written = []
    for module in (blocks, clustering):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: written.append(1) or cut(df))
    points, _ = unstructured(spark)
    clusters(points, 8, k=4, restarts=3)
    assert len(written) <= 4


@pytest.mark.parametrize("more", [{}, {"whole_bytes": 0}])
def test_odd_vectors_keep_their_rows(spark, small_blocks, more):
    odd = [(1000, "c0", None), (1001, "c0", [1.0, 2.0]), (1002, "c0", [0.5] * 9), (1003, "c0", [float("nan")] + [0.0] * 7),
           (1004, "c0", [None] + [0.5] * 7), (1005, "alone", [1.0] * 8), (1006, "none", None), (1007, "twice", [2.0] * 8),
           (1008, "twice", [2.0] * 8), (1009, "twice", [3.0] * 8)]
    points, x = unstructured(spark, n=100)
    every = points.unionByName(spark.createDataFrame(odd, SCHEMA))
    found, centroids = clusters(every, 8, k=3, restarts=2, **more)
    assert len(found) == 110
    assert found[1007] == found[1008] == 0 and found[1009] == 1 and found[1005] == found[1006] == 0
    counts = {r["label"]: r["count"] for r in centroids.groupBy("label").count().collect()}
    assert counts == {"c0": 3, "c1": 3, "alone": 1, "none": 1, "twice": 2}


def test_no_points(spark):
    found, centroids = clusters(spark.createDataFrame([], SCHEMA), 8)
    assert found == {} and centroids.count() == 0


def test_nearest_is_that_of_plain_sums():
    rng = np.random.default_rng(1)
    grid = rng.integers(-2, 3, (500, 6)).astype(float)
    for x, c in ((grid, grid[:24].reshape(3, 8, 6)), (grid * 1e-7 + 1e6, grid[:24].reshape(3, 8, 6) * 1e-7 + 1e6),
                 (grid * 1e200, grid[:24].reshape(3, 8, 6) * 1e200), (rng.standard_normal((500, 6)), rng.standard_normal((3, 8, 6)))):
        c = c.copy()
        c[1, 7] = np.nan
        with np.errstate(over="ignore", invalid="ignore"):
            own, d2, second, _ = blocks.nearest(x, c)
            plain = np.zeros((500, 3, 8))
            for j in range(6):
                plain += (x[:, None, None, j] - c[None, :, :, j]) ** 2
        plain[np.isnan(plain)] = np.inf
        assert (own == plain.argmin(axis=2)).all()
        assert d2 == pytest.approx(plain.min(axis=2), rel=1e-6, abs=1e-20)
        assert second == pytest.approx(np.sort(plain, axis=2)[:, :, 1], rel=1e-6, abs=1e-20)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_bounds_change_no_round(kind):
    """Runs that measure only points whose bounds meet against Lloyd's rounds over all points."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16)).astype(kind)
    for start in range(3):
        c = x[start * 7:start * 7 + 5].astype(float)
        run = blocks._Run(blocks.Block(x, None, np.arange(6000), None), c)
        got = run.settle(300, 0.0)
        while True:
            own = ((x.astype(float)[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[own == j].astype(float).mean(axis=0) for j in range(5)])
            if np.allclose(after, c, rtol=0, atol=1e-14):
                break
            c = after
        assert got == pytest.approx(after, abs=1e-12) and (run.own == own).all()


def test_draws_are_those_of_sparks_hash(spark):
    got = spark.range(50).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(7), F.lit(3)).alias("mixed")).collect()
    h = np.array([r["h"] for r in got])
    assert blocks._mixed(blocks._mixed(h, 7), 3).astype(np.int64).tolist() == [r["mixed"] for r in got]


def test_lost_clusters_start_again(spark):
    x = np.array([[0.0], [1.0], [2.0], [50.0], [90.0]])
    block = blocks.Block(x, None, np.arange(5), None)
    start = np.array([[[1.0], [-900.0], [-901.0]]])
    assert sorted(blocks._Run(block, start[0]).settle(300, 0.0).ravel()) == [1.0, 50.0, 90.0]
    points = spark.createDataFrame([(i, "c", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    sizes = blocks.class_sizes(points, "label", 1, 0)
    packed = blocks.pack(points, sizes, "label", "id", "vec", 1)
    state = spark.createDataFrame([("c", 0, start[0].tolist())], "label string, restart int, c array<array<double>>")
    plain = points.select("label", F.col("id").alias("point"), "vec")
    moved = clustering._moved_on(plain, packed, state, 1, 300, 0.0).first()
    assert sorted(c[0] for c in moved["c"]) == [1.0, 50.0, 90.0]


def test_further_lost_clusters_wait(spark):
    points = spark.createDataFrame([(i, 0, 0, [float(x)]) for i, x in enumerate([0, 1, 2, 50])],
                                   "id long, label int, restart int, vec array<double>")
    before = spark.createDataFrame([(0, 0, 0, [1.0]), (0, 0, 1, [-900.0]), (0, 0, 2, [-901.0])],
                                   "label int, restart int, cluster int, centroid array<double>")
    moved = clustering.lloyd_step(points, before, ["label", "restart"], "vec", 1)
    filled = clustering._refilled(points, before, moved, ["label", "restart"], "id", "vec")
    assert sorted((r["cluster"], r["centroid"]) for r in filled.collect()) == [(0, [13.25]), (1, [50.0]), (2, [-901.0])]
