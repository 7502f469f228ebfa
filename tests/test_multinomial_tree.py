import numpy as np
from pyspark.sql import functions as F

from trialmill.operators import resample


def test_every_resample_has_as_many_rows_as_the_key(spark):
    rows = [("a", float(i % 37), 1) for i in range(500)] + [(None, float(i), 1) for i in range(90)] + [("one", 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, y int")
    got = resample.multinomial_sums(df, ["k"], "x", "y", 200).collect()
    assert len(got) == 600
    assert {(r.k, r._sy) for r in got} == {("a", 500.0), (None, 90.0), ("one", 1.0)}
    assert {r._sx for r in got if r.k == "one"} == {5.0}


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), (F.col("id") * 7 % 400).alias("x"), (F.col("id") % 3 == 0).alias("y"))
    forms = [df, df.repartition(7, "x"), df.orderBy(F.desc("id")).coalesce(1)]
    found = [sorted(map(tuple, resample.multinomial_sums(f, ["k"], "x", "y", 50, blocks=16).collect())) for f in forms]
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) > 30


def test_a_tree_of_any_depth_has_the_spread_of_plain_resamples(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 60, 800)
    df = spark.createDataFrame([(int(v), 1) for v in x], "x int, y int")
    plain = x[rng.integers(0, 800, (4000, 800))].sum(axis=1)
    for blocks in (2, 64, 512):
        sums = np.array([r._sx for r in resample.multinomial_sums(df.withColumn("k", F.lit(1)), ["k"], "x", "y", 2000, blocks=blocks).collect()])
        assert abs(sums.mean() - x.sum()) < 5 * plain.std() / 2000 ** 0.5
        assert abs(sums.std() / plain.std() - 1) < 0.1


def test_one_key_with_a_million_cells(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("x"), F.lit(1).alias("y"))
    sums = resample.multinomial_sums(df, ["k"], "x", "y", 40)
    got = sums.collect()
    assert {r._sy for r in got} == {float(n)}
    spread = np.std([r._sx / n for r in got]) / (n / 12 ** 0.5 / n ** 0.5)
    assert 0.6 < spread < 1.5
    groups = [line for line in sums._jdf.queryExecution().toString().splitlines() if "InPandas" in line]
    assert groups and all("_block" in line for line in groups)
