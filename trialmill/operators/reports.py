"""Result tables and chart datasets over scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import CONDITIONS
from ..session import large_side
from .resample import poisson_ratio, rounded
from .tables import key_columns

SCORE_COLUMNS = [
    "tool_precision", "tool_recall", "tool_f1", "total_tool_calls", "redundant_calls", "first_call_correct",
    "min_req_met", "hallucination_score", "intent_fidelity_score", "functional_correct",
]


def analysis_base(results: DataFrame, scores: DataFrame, key: str | list[str] = "run_id") -> DataFrame:
    """Results with their scores; runs without scores are left out."""
    return results.join(large_side(scores), key_columns(key))


def mean(column: str, places: int = 4) -> Column:
    return F.round(F.avg(F.col(column).cast("double")), places)


# Report name -> stored column.
OVERALL = {
    "intent_fidelity": "intent_fidelity_score",
    "tool_f1": "tool_f1",
    "hallucination_mean": "hallucination_score",
    "first_call_acc": "first_call_correct",
    "min_req_met": "min_req_met",
    "format_compliance": "format_compliance",
    "tool_halluc_rate": "tool_halluc_rate",
    "func_correct_rate": "functional_flag",
    "redundancy": "redundant_calls",
    "kendall_tau": "kendall_tau",
    "avg_tokens": "total_tokens",
    "avg_output_tokens": "output_tokens",
    "avg_latency": "execution_time_sec",
}
STRATIFIED = ["intent_fidelity", "tool_f1", "hallucination_mean", "first_call_acc", "min_req_met",
              "format_compliance", "func_correct_rate", "avg_tokens"]


def with_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("functional_flag", F.col("functional_correct").cast("int"))


def condition_overall(df: DataFrame, replicates: int, success: str = "min_req_met") -> DataFrame:
    """Thirteen means per condition, the cost per success and its bootstrap interval.

    One pass over the runs feeds both the means and the resampling.
    """
    table = poisson_ratio(with_flag(df), ["condition"], "total_tokens", success, replicates, OVERALL)
    return rounded(table.withColumnRenamed("ratio", "cpstc"), [*OVERALL, "cpstc", "ci_lower", "ci_upper"])


def stratified(df: DataFrame, keys: list[str], names: list[str] = STRATIFIED) -> DataFrame:
    return with_flag(df).groupBy(*keys).agg(*[mean(OVERALL[n]).alias(n) for n in names])


#: Groups of the result cube: per condition, by model or intent, per model, and over all.
CUBE = [["condition"], ["model", "condition"], ["intent", "condition"], ["model"], []]


def result_cube(df: DataFrame, names: list[str] = STRATIFIED) -> DataFrame:
    """All result tables in one pass: means, runs and cost per success of each group of `CUBE`.

    Rows are expanded once and combined before the shuffle; `level` tells the groups apart (a bit for each of model,
    intent and condition that is summed over), so that a NULL key stays a key.
    """
    keys = ["model", "intent", "condition"]
    sets = [[F.col(k) for k in group] for group in CUBE]
    cost = F.try_divide(F.sum("total_tokens").cast("double"), F.sum(F.col("min_req_met").cast("int")))
    return with_flag(df).groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *[mean(OVERALL[n]).alias(n) for n in names], F.round(cost, 4).alias("cpstc"))


def pivot_means(df: DataFrame, index: str, measures: dict[str, str], conditions: list[str] = CONDITIONS) -> DataFrame:
    """One row per `index`, one column per measure and condition.  The conditions are given,
    so the pivot is a single aggregation."""
    cells = [F.round(F.avg(F.when(F.col("condition") == c, F.col(column).cast("double"))), 4).alias(f"{name}_{c}")
             for name, column in measures.items() for c in conditions]
    return df.groupBy(index).agg(*cells)


def hallucination_deltas(df: DataFrame) -> DataFrame:
    wide = df.groupBy("model").agg(*[
        F.avg(F.when(F.col("condition") == c, F.col("hallucination_score"))).alias(c) for c in CONDITIONS])
    return wide.select(
        "model", *[F.round(c, 4).alias(f"mean_{c}") for c in CONDITIONS],
        F.round(F.col("b") - F.col("a"), 4).alias("delta_ab"), F.round(F.col("c") - F.col("b"), 4).alias("delta_bc"))


def relative_lift(df: DataFrame, value: str, models: list[str], keys: list[str] | None = None) -> DataFrame:
    """Lift of c over a and b, with all models and with each one left out.

    Runs reduce to sums per model first; the leave-one-out scopes reuse those few rows.
    """
    keys = keys or []
    sums = []
    for c in CONDITIONS:
        here = F.when(F.col("condition") == c, F.col(value))
        sums += [F.sum(here).alias(f"s_{c}"), F.count(here).alias(f"n_{c}")]
    per_model = df.groupBy("model", *keys).agg(*sums)
    scopes = F.array(F.lit("all"), *[F.when(F.col("model") != m, F.lit(f"without_{m}")) for m in models])
    spread = per_model.withColumn("scope", F.explode(scopes)).filter(F.col("scope").isNotNull())
    means = spread.groupBy("scope", *keys).agg(*[
        F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}")).alias(f"m_{c}") for c in CONDITIONS])
    lift = lambda top, base: F.round(100 * (F.try_divide(f"m_{top}", f"m_{base}") - 1), 4)
    return means.select("scope", *keys, *[F.round(f"m_{c}", 4).alias(f"mean_{c}") for c in CONDITIONS],
                        lift("c", "a").alias("lift_ca_pct"), lift("c", "b").alias("lift_cb_pct"))


def long_means(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean(column).alias(name) for name, column in measures.items()])


def token_scatter(df: DataFrame) -> DataFrame:
    return df.select("run_id", "condition", "total_tokens", "tool_f1")


def pareto(df: DataFrame, replicates: int, success: str = "min_req_met") -> DataFrame:
    """Cost against quality per condition, interval offsets, and whether a point is on the
    frontier.  The frontier compares the handful of condition points, held in one array."""
    points = poisson_ratio(df, ["condition"], "total_tokens", success, replicates, {"y": "tool_f1"})
    packed = points.agg(F.collect_list(F.struct(
        "condition", F.col("ratio").alias("x"), "y", "ci_lower", "ci_upper")).alias("all"))
    each = packed.select("all", F.explode("all").alias("p"))
    p = F.col("p")
    dominated = F.exists("all", lambda o: (o["x"] <= p["x"]) & (o["y"] >= p["y"]) & ((o["x"] < p["x"]) | (o["y"] > p["y"])))
    return each.select(
        p["condition"].alias("condition"), F.round(p["x"], 4).alias("cpstc"), F.round(p["y"], 4).alias("mean_f1"),
        F.round(p["x"] - p["ci_lower"], 4).alias("err_low"), F.round(p["ci_upper"] - p["x"], 4).alias("err_high"),
        (~dominated).alias("on_frontier"))


def failure_taxonomy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs per outcome class; the first class that applies counts."""
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("total_tool_calls") == 0, "no_call")
        .when(F.col("invalid_calls") > 0, "invalid_name")
        .when(F.col("min_req_met") == 0, "minimum_not_met")
        .otherwise("success")
    )
    return df.groupBy(*keys, outcome.alias("outcome")).agg(F.count("*").alias("n"))
