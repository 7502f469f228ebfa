"""Scoring runs against gold standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import toolcalls, vectors
from ..functions.text import first_code_block, judge_score
from ..session import cut_lineage, large_side, small_side
from ..sources.schemas import SCORES
from .tables import ensure_keys, evolve, key_columns, partial_update

Key = str | list[str]


#: Expected sequence and alternatives with what scoring asks of each: distinct names and the first one.
CANDIDATES = "_candidates"


def candidate_column(expected: str = "expected_tools", alternatives: str = "alternative_tool_sequences") -> Column:
    none = F.array().cast("array<array<string>>")
    return F.transform(
        F.concat(F.array(F.col(expected)), F.coalesce(F.col(alternatives), none)),
        lambda seq: F.struct(seq.alias("seq"), F.size(F.array_distinct(seq)).alias("size"), F.get(seq, F.lit(0)).alias("head")))


def with_candidates(gold: DataFrame) -> DataFrame:
    """Gold with its candidate sequences made ready once a task, before it meets the runs of the task."""
    return gold.withColumn(CANDIDATES, candidate_column())


def with_sequence_scores(
    df: DataFrame, actual: str = "tool_names", expected: str = "expected_tools",
    alternatives: str = "alternative_tool_sequences", minimum: str = "minimum_required_tools",
) -> DataFrame:
    """Best-sequence precision, recall and F1, first-call and minimum checks, per row.

    Row-local: the candidate sequences stay an array, nothing is exploded or shuffled.
    The expected sequence wins F1 ties for precision and recall; the first call counts as
    correct when any of the tied best sequences starts with it.
    """
    names = F.coalesce(F.col(actual), F.array().cast("array<string>"))
    # What only depends on the gold standard comes with it from `with_candidates`, or is worked out here.
    known = CANDIDATES in df.columns
    candidates = F.col(CANDIDATES) if known else candidate_column(expected, alternatives)

    def rates(c: Column, order: Column) -> Column:
        p = F.coalesce(F.try_divide(c["hits"], F.col("_called")), F.lit(0.0))
        r = F.coalesce(F.try_divide(c["hits"], c["size"]), F.lit(0.0))
        return F.struct(
            F.when(c["hits"] > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
            (-order).alias("order"), p.alias("p"), r.alias("r"), c["starts"].alias("starts"))

    found = F.transform(candidates, lambda c: F.struct(
        F.size(F.array_intersect(F.col("_names"), c["seq"])).cast("double").alias("hits"), c["size"].alias("size"),
        F.coalesce(c["head"] == F.col("_head"), F.lit(False)).alias("starts")))
    staged = (
        df.withColumn("_names", names)
        .withColumns({"_called": F.size(F.array_distinct("_names")), "_head": F.get("_names", F.lit(0))})
        .withColumn("_scored", F.transform(found, rates))
        .withColumn("_best", F.array_max("_scored"))
    )
    first = F.exists("_scored", lambda s: (s["f1"] == F.col("_best.f1")) & s["starts"])
    return staged.withColumns({
        "tool_precision": F.round("_best.p", 4),
        "tool_recall": F.round("_best.r", 4),
        "tool_f1": F.round("_best.f1", 4),
        "total_tool_calls": F.size("_names").cast("long"),
        "redundant_calls": (F.size("_names") - F.col("_called")).cast("long"),
        "first_call_correct": first.cast("long"),
        "min_req_met": (F.size(F.array_except(F.col(minimum), F.col("_names"))) == 0).cast("long"),
    }).drop("_names", "_called", "_head", "_scored", "_best", CANDIDATES)


def called_names(calls: Column, valid_only: bool = False) -> Column:
    """Names that enter the score.  Invalid names count by default, as in stored scores."""
    return F.transform(toolcalls.valid_calls(calls) if valid_only else calls, lambda c: c["tool"])


def score_tools(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Tool metrics for runs with `run_id, task_id, tool_names`; runs without gold are left out."""
    return with_sequence_scores(runs.join(large_side(with_candidates(gold)), "task_id"))


def intent_preservation(responses: DataFrame, gold: DataFrame, key: str = "task_id") -> DataFrame:
    """Cosine of each response vector with its gold vector.

    Gold norms are computed once per gold row, before the join.
    """
    right = gold.select(key, F.col("gold_embedding"), vectors.norm(F.col("gold_embedding")).alias("_gold_norm"))
    joined = responses.join(right, key)
    return joined.withColumn("intent_preservation", vectors.cosine_from(
        vectors.dot(F.col("gold_embedding"), F.col("embedding")),
        F.col("_gold_norm"), vectors.norm(F.col("embedding")),
    )).drop("_gold_norm", "gold_embedding")


def rule_check(runs: DataFrame, rules: DataFrame, key: str = "task_id") -> DataFrame:
    """`functional_correct`: every clause of the task holds on the extracted code.

    Clauses are gathered per task first (a bounded rule table), so each run meets one row
    and the check is a row-local expression.  Tasks without rules get NULL.
    """
    clauses = rules.groupBy(key).agg(F.collect_list(F.struct("ignore_case", "any_of")).alias("_clauses"))
    code = runs.withColumn("_code", first_code_block(F.col("response"))).withColumn("_lower", F.lower("_code"))
    joined = code.join(small_side(clauses), key, "left")

    def holds(clause: Column) -> Column:
        return F.exists(clause["any_of"], lambda word: F.when(
            clause["ignore_case"], F.contains(F.col("_lower"), word)).otherwise(F.contains(F.col("_code"), word)))

    return joined.withColumn(
        "functional_correct", F.when(F.col("_clauses").isNotNull(), F.forall("_clauses", holds))
    ).drop("_clauses", "_code", "_lower")


def unscored_runs(runs: DataFrame, scores: DataFrame, marker: str = "tool_f1", key: Key = "run_id") -> DataFrame:
    """Good runs without a finished score.

    A key whose row is still empty (a crash between reserving and scoring) is not done.
    """
    good = runs.filter(F.col("error").isNull() & F.col("response").isNotNull())
    keys = key_columns(key)
    return good.join(large_side(scores.filter(F.col(marker).isNotNull()).select(*keys)), keys, "left_anti")


def rescore_selection(runs: DataFrame, model: str | None = None) -> DataFrame:
    good = runs.filter(F.col("error").isNull() & F.col("response").isNotNull())
    return good.filter(F.col("model") == model) if model else good


TOOL_COLUMNS = ["tool_precision", "tool_recall", "tool_f1", "total_tool_calls", "redundant_calls",
                "first_call_correct", "min_req_met"]


def rescore_tools(scores: DataFrame, runs: DataFrame, gold: DataFrame, key: Key = "run_id") -> DataFrame:
    """The score table with the tool columns of `runs` recomputed and all others untouched.

    `runs` has `run_id, task_id, tool_names`; runs not in the table yet get a row.
    """
    fresh = score_tools(runs, gold).select(*key_columns(key), *TOOL_COLUMNS)
    return partial_update(ensure_keys(scores, runs, key), fresh, key, TOOL_COLUMNS)


def rescore_functional(scores: DataFrame, runs: DataFrame, rules: DataFrame, key: str = "task_id", run: Key = "run_id") -> DataFrame:
    """The score table with `functional_correct` recomputed for runs whose task has rules."""
    tested = runs.join(small_side(rules.select(key).distinct()), key, "left_semi")
    fresh = rule_check(tested, rules, key).select(*key_columns(run), "functional_correct")
    return partial_update(ensure_keys(scores, runs, run), fresh, run, ["functional_correct"])


def rescore_intent(scores: DataFrame, replies: DataFrame, reply: str = "fidelity_reply", key: Key = "run_id") -> DataFrame:
    """The score table with `intent_fidelity_score` read again from the judge's replies by `run_id`."""
    fresh = replies.select(*key_columns(key), judge_score(F.col(reply))[0].alias("intent_fidelity_score"))
    return partial_update(ensure_keys(scores, replies, key), fresh, key, ["intent_fidelity_score"])


def standard_scoring(runs: DataFrame, scores: DataFrame, gold: DataFrame, rules: DataFrame, replies: DataFrame,
                     rule_key: str = "task_id", key: Key = "run_id") -> DataFrame:
    """The whole score table after every good run without a finished score was scored.

    `runs` is the run log with the response's `embedding`; `gold` has the tool sequences and
    `gold_embedding`; `replies` has one row a run with `hallucination_reply` and `fidelity_reply`.
    Tool scores, rule check and cosine are row-local after one join with gold; a missing or broken
    judge reply counts 0.  Runs without gold keep the row they had.
    """
    keys = key_columns(key)
    due = unscored_runs(runs, scores, key=keys)
    named = due.withColumn("tool_names", called_names(toolcalls.extract_tool_calls(F.col("response"))))
    slim = rule_check(named, rules, rule_key).select("run_id", "task_id", "tool_names", "embedding", "functional_correct")
    told = score_tools(slim, gold).join(
        large_side(replies.select(*keys, "hallucination_reply", "fidelity_reply")), keys, "left")
    kept = vectors.cosine_from(
        vectors.dot(F.col("gold_embedding"), F.col("embedding")),
        vectors.norm(F.col("gold_embedding")), vectors.norm(F.col("embedding")))
    full = told.withColumns({
        "intent_preservation": F.round(kept, 4),
        "hallucination_score": judge_score(F.col("hallucination_reply"))[0].cast("long"),
        "intent_fidelity_score": judge_score(F.col("fidelity_reply"))[0].cast("long"),
    })
    stored = evolve(scores, SCORES)
    fresh = cut_lineage(evolve(full, SCORES).select(*stored.columns))
    return stored.join(large_side(fresh.select(*keys)), keys, "left_anti").unionByName(fresh)


def score_summary(runs: DataFrame, scores: DataFrame, key: Key = "run_id") -> DataFrame:
    keys = key_columns(key)
    joined = runs.select(*keys, "condition", "total_tokens").join(
        large_side(scores.select(*keys, "intent_fidelity_score", "tool_f1", "hallucination_score")), keys)
    return joined.groupBy("condition").agg(
        F.avg("intent_fidelity_score").alias("avg_intent_fidelity"),
        F.avg("tool_f1").alias("avg_f1"),
        F.avg("hallucination_score").alias("avg_hallucination"),
        F.avg("total_tokens").alias("avg_tokens"),
    )


def cpstc(tokens: Column, successes: Column) -> Column:
    """Tokens per successful task; NULL when nothing succeeded."""
    return F.try_divide(tokens.cast("double"), successes)


def token_stats(runs: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Token totals and averages; a NULL success is no success."""
    wins = F.count_if(F.coalesce(success.cast("boolean"), F.lit(False)))
    spent = F.col("input_tokens") + F.col("output_tokens")
    return runs.groupBy(*keys).agg(
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum(spent).alias("total_tokens"),
        F.round(F.avg("input_tokens"), 1).alias("avg_input_tokens"),
        F.round(F.avg("output_tokens"), 1).alias("avg_output_tokens"),
        F.round(F.avg(spent), 1).alias("avg_total_tokens"),
        wins.alias("successful_tasks"),
        cpstc(F.sum(spent), wins).alias("cpstc"),
    )
