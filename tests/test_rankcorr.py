import numpy as np
import pytest

from trialmill.operators.rankcorr import column_kendall_tau, surplus


def plain(rows):
    x, y = (np.array(v, float) for v in zip(*rows))
    sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    upper = np.triu(np.ones((len(x), len(x)), bool), 1)
    return int((sx * sy)[upper].sum()), int((sx == 0)[upper].sum()), int((sy == 0)[upper].sum())


def test_surplus_of_weighted_cells():
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 200):
        x, y, w = rng.integers(0, 12, size), rng.integers(0, 12, size), rng.integers(1, 4, size)
        rows = [(a, b) for a, b, n in zip(x, y, w) for _ in range(n)]
        assert surplus(x, y, w) == surplus(x, y, w.astype(object)) == plain(rows)[0]
    heavy = np.array([2 ** 40, 2 ** 41, 3])
    assert surplus(np.array([1, 2, 3]), np.array([1, 2, 2]), heavy) == 2 ** 81 + 3 * 2 ** 40


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("hot", [0, 300])
def test_tau_is_that_of_all_pairs(spark, ranges, hot):
    rng = np.random.default_rng(ranges)
    x = rng.integers(0, 60, 500)
    rows = [(int(a), float(a // 3 + rng.integers(0, 25))) for a in x] + [(30, float(i % 17)) for i in range(hot)]
    df = spark.createDataFrame(rows + [(None, 1.0), (4, None), (5, float("nan"))], "x long, y double")
    got = column_kendall_tau(df, "x", "y", ranges).first()
    s, tx, ty = plain(rows)
    n = len(rows)
    assert (got.n, int(got.surplus), int(got.ties_x), int(got.ties_y)) == (n, s, tx, ty)
    every = n * (n - 1) // 2
    assert abs(got.tau_b - s / ((every - tx) * (every - ty)) ** 0.5) < 1e-12


def test_tau_defined_cases(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "x long, y double")
    assert column_kendall_tau(df, "x", "y").first().tau_b is None
    empty = column_kendall_tau(df.limit(0), "x", "y").first()
    assert empty.n == 0 and empty.tau_b is None
