import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.functions.studentised import range_critical, range_tail
from trialmill.operators.inference import tukey_hsd

# Published upper 5 % points of the studentised range: (degrees of freedom, groups, q).
FIVE_PERCENT = [
    (5, 3, 4.60), (5, 4, 5.22), (5, 5, 5.67), (5, 10, 6.99),
    (10, 2, 3.15), (10, 3, 3.88), (10, 4, 4.33), (10, 5, 4.65), (10, 10, 5.60),
    (20, 3, 3.58), (20, 4, 3.96), (20, 5, 4.23), (20, 10, 5.01),
    (60, 3, 3.40), (60, 4, 3.74), (60, 5, 3.98), (60, 10, 4.65),
    (120, 3, 3.36), (120, 5, 3.92), (120, 10, 4.56),
    (10 ** 9, 3, 3.31), (10 ** 9, 4, 3.63), (10 ** 9, 5, 3.86), (10 ** 9, 10, 4.47),
]


def test_published_points(spark):
    df = spark.createDataFrame(FIVE_PERCENT, "df long, k int, q double")
    out = df.select("*", range_critical(F.col("k"), F.col("df")).alias("root")).withColumn(
        "back", range_tail(F.col("root"), F.col("k"), F.col("df"))).collect()
    for r in out:
        assert abs(r.root - r.q) < 0.0051, r
        assert abs(r.back - 0.05) < 1e-9, r


def test_two_groups_are_a_t_test(spark):
    from trialmill.functions.distributions import t_two_sided
    df = spark.createDataFrame([(q, d) for q in (0.0, 0.3, 2.0, 6.0, 40.0) for d in (1, 2, 7, 200, 10 ** 7)], "q double, df long")
    for r in df.select(range_tail(F.col("q"), F.lit(2), F.col("df")).alias("a"),
                       t_two_sided(F.col("q") / F.sqrt(F.lit(2.0)), F.col("df")).alias("b")).collect():
        assert abs(r.a - r.b) < 1e-9


def test_defined_cases(spark):
    df = spark.createDataFrame([(2.0, 1, 10), (2.0, 3, 0), (None, 3, 10), (2.0, 3, None)], "q double, k int, df long")
    out = df.select(range_tail(F.col("q"), F.col("k"), F.col("df")).alias("p"),
                    range_critical(F.col("k"), F.col("df")).alias("c")).collect()
    assert [r.p for r in out] == [None] * 4
    assert [r.c is None for r in out] == [True, True, False, True]


def test_hsd_against_simulated_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g, shift in (("a", 0.0), ("b", 0.6), ("c", 1.4), ("d", 0.1))
            for x in rng.normal(shift, 1.0, 9)]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v double")
    got = {(r.first, r.second): r for r in tukey_hsd(df, [], "g", "v").collect()}
    assert len(got) == 6
    groups = {g: np.array([x for h, x in rows if h == g]) for g in "abcd"}
    mse = sum(v.var(ddof=1) * 8 for v in groups.values()) / 32
    z = rng.normal(size=(400_000, 4))
    ranges = (z.max(axis=1) - z.min(axis=1)) / np.sqrt(rng.chisquare(32, 400_000) / 32)
    for (a, b), r in got.items():
        gap = groups[b].mean() - groups[a].mean()
        assert abs(r.q - abs(gap) / np.sqrt(mse / 9)) < 1e-4
        assert abs(r.p - (ranges > r.q).mean()) < 0.004
        half = np.quantile(ranges, 0.95) * np.sqrt(mse / 9)
        assert abs(r.ci_lower - (gap - half)) < 0.02 and abs(r.ci_upper - (gap + half)) < 0.02
        assert r.significant == (r.p < 0.05) == (r.ci_lower > 0 or r.ci_upper < 0)


def test_hsd_of_flat_small_and_empty_groups(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", 1.0), ("y", "b", 4.0), ("z", "a", 3.0)],
                               "part string, g string, v double")
    got = {r.part: r for r in tukey_hsd(df, ["part"], "g", "v").collect()}
    assert set(got) == {"x", "y"}
    assert (got["x"].q, got["x"].p, got["x"].ci_lower, got["x"].ci_upper) == (None, None, 1.0, 1.0)
    assert (got["y"].mean_diff, got["y"].q, got["y"].p, got["y"].ci_lower, got["y"].significant) == (3.0, None, None, None, None)
    assert tukey_hsd(df.limit(0), ["part"], "g", "v").count() == 0
