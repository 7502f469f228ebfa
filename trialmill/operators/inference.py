"""Significance tests and effect sizes.

Data is reduced to group statistics by aggregates; the formulas then run on result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import ALPHA, CONDITION_PAIRS, CONDITIONS, FAMILY_SIZE
from ..functions import distributions as dist, studentised
from ..session import cut_lineage, small_side

MEDIAN_BINS = 1024


def by_condition(df: DataFrame, units: list[str], value: str, conditions: list[str] = CONDITIONS) -> DataFrame:
    """One row per unit with the mean of `value` under each condition."""
    means = [F.avg(F.when(F.col("condition") == c, F.col(value))).alias(c) for c in conditions]
    return df.groupBy(*units).agg(*means)


def cohens_d_of(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Pooled-SD effect size of group 1 over group 2; 0 when a group is too small or flat."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    effect = F.round(F.try_divide(m1 - m2, pooled), 4)
    return F.when((n1 < 2) | (n2 < 2), F.lit(0.0)).otherwise(F.coalesce(effect, F.lit(0.0)))


def mean_interval(n: Column, mean: Column, sd: Column) -> tuple[Column, Column]:
    """95 % t-interval of a mean; a single value is its own interval, none gives 0."""
    half = dist.t_critical(n - 1) * sd / F.sqrt(n)
    centre = F.coalesce(mean, F.lit(0.0))
    low = F.when(n < 2, centre).otherwise(F.round(mean - half, 4))
    high = F.when(n < 2, centre).otherwise(F.round(mean + half, 4))
    return low, high


def paired_ttest(df: DataFrame, units: list[str], value: str, pairs=CONDITION_PAIRS, family: int = FAMILY_SIZE) -> DataFrame:
    """Paired t-tests between conditions on per-unit means, with pooled effect size,
    intervals of both means and the Bonferroni flag.  All pairs come from one pass."""
    wide = by_condition(df, units, value)
    stats = []
    for first, second in pairs:
        both = F.col(first).isNotNull() & F.col(second).isNotNull()
        x, y = F.when(both, F.col(first)), F.when(both, F.col(second))
        stats.append(F.struct(
            F.lit(first).alias("first"), F.lit(second).alias("second"),
            F.count(x).alias("n"), F.avg(x).alias("mean_first"), F.avg(y).alias("mean_second"),
            F.var_samp(x).alias("var_first"), F.var_samp(y).alias("var_second"),
            F.avg(y - x).alias("mean_diff"), F.stddev_samp(y - x).alias("sd_diff"),
        ).alias(f"{first}_{second}"))
    rows = wide.agg(*stats).select(F.explode(F.array(*[f"{a}_{b}" for a, b in pairs])).alias("s")).select("s.*")
    n = F.col("n")
    low1, high1 = mean_interval(n, F.col("mean_first"), F.sqrt("var_first"))
    low2, high2 = mean_interval(n, F.col("mean_second"), F.sqrt("var_second"))
    tested = rows.withColumn("t_raw", F.try_divide("mean_diff", F.try_divide(F.col("sd_diff"), F.sqrt(n))))
    tested = tested.withColumn("p_raw", dist.t_two_sided(F.col("t_raw"), n - 1))
    return tested.select(
        "first", "second", "n",
        F.round("mean_first", 4).alias("mean_first"), low1.alias("first_low"), high1.alias("first_high"),
        F.round("mean_second", 4).alias("mean_second"), low2.alias("second_low"), high2.alias("second_high"),
        F.round("t_raw", 4).alias("t"), F.round("p_raw", 6).alias("p"),
        cohens_d_of(n, F.col("mean_second"), F.col("var_second"), n, F.col("mean_first"), F.col("var_first")).alias("d"),
        (F.col("p_raw") < ALPHA / family).alias("significant"),
    )


def cohens_d(df: DataFrame, value: str, pairs=CONDITION_PAIRS) -> DataFrame:
    """Effect size between whole condition groups, second over first."""
    stats = [F.struct(
        F.count(F.when(F.col("condition") == c, F.col(value))).alias("n"),
        F.avg(F.when(F.col("condition") == c, F.col(value))).alias("m"),
        F.var_samp(F.when(F.col("condition") == c, F.col(value))).alias("v"),
    ).alias(c) for c in CONDITIONS]
    one = df.agg(*stats)
    rows = [F.struct(
        F.lit(a).alias("first"), F.lit(b).alias("second"),
        cohens_d_of(*[F.col(f"{b}.{s}") for s in "nmv"], *[F.col(f"{a}.{s}") for s in "nmv"]).alias("d"),
    ) for a, b in pairs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_ci95(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    low, high = mean_interval(F.col("n"), F.col("_m"), F.col("_s"))
    return stats.select(*keys, "n", F.round("_m", 4).alias("mean"), low.alias("ci_lower"), high.alias("ci_upper"))


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per `_key` (a struct of `keys`) and distinct value, NULL among them, written once."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return cut_lineage(df.groupBy(key.alias("_key"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))


def exact_median(cells: DataFrame) -> DataFrame:
    """Exact median per `_key` of values `_v` that occur `_n` times; NULLs do not count.

    Both middle ranks are closed in on: each round counts the range that holds a rank in `MEDIAN_BINS`
    pieces, so no task ever holds a key's values, however many differ.  The least and the greatest value of a
    range fall in different pieces, hence every round narrows.
    """
    cells = cells.filter(F.col("_v").isNotNull())
    ends = cells.groupBy("_key").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    middle = F.array(F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2))
    at = ends.select("_key", "_lo", "_hi", F.posexplode(middle).alias("_side", "_rank"))
    ordered = Window.partitionBy("_key", "_side").orderBy("_bin")
    while True:
        at = cut_lineage(at)
        if at.filter(F.col("_lo") < F.col("_hi")).isEmpty():
            return at.groupBy("_key").agg(F.avg("_lo").alias("median"))
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        piece = F.floor((v - lo) / F.when(lo < hi, hi - lo).otherwise(1.0) * MEDIAN_BINS)
        bins = F.when(v == lo, 0).when(v == hi, MEDIAN_BINS - 1).otherwise(
            F.coalesce(F.least(piece.try_cast("int"), F.lit(MEDIAN_BINS - 1)), F.lit(MEDIAN_BINS // 2)))
        counted = cells.join(small_side(at), "_key").filter((v >= lo) & (v <= hi)).groupBy(
            "_key", "_side", "_rank", bins.alias("_bin")).agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_n"))
        before = F.sum("_n").over(ordered) - F.col("_n")
        at = counted.withColumn("_before", before).filter(
            (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).select(
            "_key", "_lo", "_hi", "_side", (F.col("_rank") - F.col("_before")).alias("_rank"))


def describe_metric(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, spread, median, ends and interval per key, from one pass over the facts."""
    cells = _value_counts(df, keys, value)
    times = F.when(F.col("_v").isNotNull(), F.col("_n"))
    stats = cells.groupBy("_key").agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum(times)).alias("_m"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.coalesce(F.sum(times), F.lit(0)).alias("n"))
    around = cells.join(small_side(stats.select("_key", "_m", "n")), "_key").groupBy("_key").agg(
        F.sqrt(F.try_divide(F.sum(F.col("_n") * F.pow(F.col("_v") - F.col("_m"), 2)), F.max("n") - 1)).alias("_s"))
    stats = stats.join(around, "_key").join(exact_median(cells), "_key", "left")
    low, high = mean_interval(F.col("n"), F.col("_m"), F.col("_s"))
    return stats.select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], F.round("_m", 4).alias("mean"), F.round("_s", 4).alias("std"),
        F.round("median", 4).alias("median"),
        F.round("_lo", 4).alias("min"), F.round("_hi", 4).alias("max"), "n",
        low.alias("ci_lower"), high.alias("ci_upper"))


def _group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def one_way_anova(df: DataFrame, by: list[str], factor: str, value: str, levels: int | None = None) -> DataFrame:
    """F-test of `value` across `factor`, per `by` group.

    Groups of two rows or fewer, or a missing level, are reported as insufficient.
    The window runs over group statistics: one row per group and level.
    """
    stats = _group_stats(df, by + [factor], value)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    sums = stats.withColumn("g", grand).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.min("n").alias("least"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"))
    enough = F.col("least") > 2
    if levels:
        enough = enough & (F.col("k") == levels)
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    ratio = F.try_divide(F.try_divide("ssb", df1), F.try_divide("ssw", df2))
    tested = sums.withColumn("f_raw", F.when(enough, ratio))
    return tested.select(
        *by, df1.alias("df1"), df2.alias("df2"), F.round("f_raw", 4).alias("f"),
        F.round(F.when(F.col("f_raw").isNotNull(), dist.f_tail(F.col("f_raw"), df1, df2)), 6).alias("p"),
        F.when(enough, "ok").otherwise("insufficient").alias("status"))


def two_way_anova(df: DataFrame, block: str, first: str, second: str, value: str,
                  first_levels: list[str], second_levels: list[str]) -> DataFrame:
    """Two factors with interaction on complete blocks (every cell of a block holds one value).

    A block is one row with a column per cell, which combines before the shuffle; all sums of
    squares follow from the cells' statistics.
    """
    pairs = [(x, y) for x in first_levels for y in second_levels]
    inside = [F.when((F.col(first) == x) & (F.col(second) == y), F.col(value)) for x, y in pairs]
    blocks = df.groupBy(block).agg(
        F.count("*").alias("_rows"), F.array(*[F.avg(c) for c in inside]).alias("_cells"))
    whole = blocks.filter((F.col("_rows") == len(pairs)) & F.forall("_cells", lambda c: c.isNotNull()))
    named = F.array(*[F.struct(F.lit(x).alias(first), F.lit(y).alias(second), F.col("_cells")[i].alias(value))
                      for i, (x, y) in enumerate(pairs)])
    cell = _group_stats(whole.select(F.explode(named).alias("_cell")).select("_cell.*"), [first, second], value)
    every = Window.partitionBy(F.lit(1))
    cell = cell.withColumns({
        "g": F.avg("m").over(every),
        "r": F.avg("m").over(Window.partitionBy(first)),
        "c": F.avg("m").over(Window.partitionBy(second)),
    })
    sums = cell.agg(
        F.sum(F.col("n") * F.pow(F.col("r") - F.col("g"), 2)).alias("ss_first"),
        F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), 2)).alias("ss_second"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("r") - F.col("c") + F.col("g"), 2)).alias("ss_inter"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ss_error"),
        F.sum("n").alias("total"), F.count_distinct(first).alias("a"), F.count_distinct(second).alias("b"))
    a, b = F.col("a"), F.col("b")
    terms = [(first, "ss_first", a - 1), (second, "ss_second", b - 1), ("interaction", "ss_inter", (a - 1) * (b - 1))]
    df2 = F.col("total") - a * b
    rows = [F.struct(F.lit(name).alias("term"), F.col(ss).alias("ss"), df1.alias("df1"), df2.alias("df2"),
                     F.try_divide(F.try_divide(F.col(ss), df1), F.try_divide("ss_error", df2)).alias("f_raw"))
            for name, ss, df1 in terms]
    out = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("term", F.round("ss", 4).alias("ss"), "df1", "df2", F.round("f_raw", 4).alias("f"),
                      F.round(dist.f_tail(F.col("f_raw"), F.col("df1"), F.col("df2")), 6).alias("p"))


def tukey_q(df: DataFrame, factor: str, value: str) -> DataFrame:
    """Studentised-range statistic for every two levels; levels are few, rows are not."""
    stats = _group_stats(df, [factor], value)
    table = stats.agg(
        F.array_sort(F.collect_list(F.struct(F.col(factor).alias("level"), "n", "m"))).alias("g"),
        (F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"))
    first = table.select("g", "mse", F.posexplode("g").alias("i", "x"))
    pair = first.select("mse", "x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("x.n") + 1 / F.col("y.n")))
    return pair.select(
        F.col("x.level").alias("first"), F.col("y.level").alias("second"),
        F.round(F.col("y.m") - F.col("x.m"), 4).alias("mean_diff"),
        F.round(F.try_divide(F.abs(F.col("y.m") - F.col("x.m")), error), 4).alias("q"))


def tukey_hsd(df: DataFrame, by: list[str], factor: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """Every two levels of `factor` per `by` group, corrected for the number of levels: difference (second less
    first), q, p and simultaneous interval, for unequal sizes too (Tukey-Kramer).

    Rows are reduced to level statistics by one aggregate; the quadrature runs once a group and once a pair.  Levels without values
    are left out.  Without spread inside the levels q and p are NULL and the interval is the difference; without
    degrees of freedom the interval is NULL as well.
    """
    stats = _group_stats(df, by + [factor], value).where("n > 0")
    table = stats.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(factor).alias("level"), "n", "m"))).alias("g"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("_within"),
        (F.sum("n") - F.count("*")).alias("df"), F.count("*").alias("_k")).where("_k > 1")
    # written once: the plan would otherwise repeat the quadrature for every column that uses it
    table = cut_lineage(table.withColumns({
        "mse": F.try_divide("_within", F.col("df")), "_bound": studentised.range_critical(F.col("_k"), F.col("df"), alpha)}))
    first = table.select(*by, "g", "mse", "df", "_k", "_bound", F.posexplode("g").alias("i", "x"))
    pair = first.select(*by, "mse", "df", "_k", "_bound", "x", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("y"))
    gap = F.col("y.m") - F.col("x.m")
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("x.n") + 1 / F.col("y.n")))
    tested = pair.withColumns({"_gap": gap, "_error": error}).withColumn("_q", F.try_divide(F.abs("_gap"), F.col("_error")))
    tested = cut_lineage(tested.withColumn("_p", studentised.range_tail(F.col("_q"), F.col("_k"), F.col("df"))))
    half = F.col("_bound") * F.col("_error")
    return tested.select(
        *by, F.col("x.level").alias("first"), F.col("y.level").alias("second"), "df",
        F.round("_gap", 4).alias("mean_diff"), F.round("_q", 4).alias("q"), F.round("_p", 6).alias("p"),
        F.round(F.col("_gap") - half, 4).alias("ci_lower"), F.round(F.col("_gap") + half, 4).alias("ci_upper"),
        (F.col("_p") < alpha).alias("significant"))


def mcnemar_exact(df: DataFrame, units: list[str], value: str, first: str = "a", second: str = "c") -> DataFrame:
    """Exact McNemar test of a 0/1 outcome between two conditions, paired by unit."""
    wide = by_condition(df, units, value)
    x, y = F.col(first), F.col(second)
    table = wide.agg(
        F.count_if((x == 1) & (y == 1)).alias("yy"), F.count_if((x == 1) & (y == 0)).alias("yn"),
        F.count_if((x == 0) & (y == 1)).alias("ny"), F.count_if((x == 0) & (y == 0)).alias("nn"))
    p = dist.binomial_two_sided_half(F.least("yn", "ny"), F.col("yn") + F.col("ny"))
    return table.withColumn("p", F.round(p, 6))


def cohens_kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two raters.  Rows reduce to the confusion table, labels to its margins."""
    confusion = df.groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count("*").alias("n"))
    margins = confusion.select(F.explode(F.array(
        F.struct(F.col("x").alias("label"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col"),
                 F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0).cast("long").alias("same")),
        F.struct(F.col("y").alias("label"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col"),
                 F.lit(0).cast("long").alias("same")),
    )).alias("m")).select("m.*").groupBy("label").agg(
        F.sum("row").alias("row"), F.sum("col").alias("col"), F.sum("same").alias("same"))
    totals = margins.agg(F.sum("row").alias("n"), F.sum("same").alias("agree"),
                         F.sum(F.col("row").cast("double") * F.col("col")).alias("chance"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    po, pe = F.try_divide("agree", "n"), F.try_divide("chance", F.col("n").cast("double") * F.col("n"))
    kappa = F.when(n == 0, 0.0).when(pe == 1, 1.0).otherwise(F.round((po - pe) / (1 - pe), 4))
    return totals.select(n.alias("n"), F.coalesce("agree", F.lit(0)).cast("long").alias("agree"), kappa.alias("kappa"))
