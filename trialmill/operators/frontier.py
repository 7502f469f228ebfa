"""Cost against quality: the rows that no cheaper or equally cheap row beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, small_side

RANGES = 256


def frontier(df: DataFrame, keys: list[str], cost: str, quality: str, ranges: int = RANGES) -> DataFrame:
    """Rows of `df` on the frontier of their keys: cheaper ones are all worse, equally cheap ones no better.

    Rows reduce to the best quality of each cost first (an aggregate that combines before the shuffle).  Costs are cut
    into `ranges` of about as many distinct values each; a range knows the best of all cheaper ranges, so no task
    holds the points of a key.  The points are read three times, so they are written once.  Rows of one point stay together, NULL and NaN in either column leave a row out.
    """
    plain = cut_lineage(df).where(F.col(cost).isNotNull() & F.col(quality).isNotNull() & ~F.isnan(F.col(quality).cast("double")))
    best = cut_lineage(plain.groupBy(*keys, F.col(cost).alias("_cost")).agg(F.max(quality).alias("_best")))
    cuts = best.groupBy(*keys).agg(F.percentile_approx("_cost", [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    same = lambda left, right: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys] or [F.lit(True)]
    placed = best.alias("p").join(cuts.alias("c"), same("p", "c")).select(
        *[F.col(f"p.{k}") for k in keys], "_cost", "_best", F.size(F.filter("_cuts", lambda x: x < F.col("_cost"))).alias("_range"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys, "_range").agg(F.max("_best").alias("_top")).withColumn("_carry", F.max("_top").over(before))
    cheaper = Window.partitionBy(*keys, "_range").orderBy("_cost").rowsBetween(Window.unboundedPreceding, -1)
    beaten = placed.withColumn("_inside", F.max("_best").over(cheaper)).alias("p").join(
        carried.alias("c"), [*same("p", "c"), F.col("p._range") == F.col("c._range")])
    ahead = F.greatest("_carry", "_inside")  # NULL only where neither is known
    kept = beaten.where(ahead.isNull() | (F.col("_best") > ahead)).select(*[F.col(f"p.{k}") for k in keys], "_cost", "_best")
    point = [F.col(f"d.{cost}") == F.col("f._cost"), F.col(f"d.{quality}") == F.col("f._best")]
    return plain.alias("d").join(small_side(kept).alias("f"), [*same("d", "f"), *point], "left_semi")
