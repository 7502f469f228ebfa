"""Events in one row group: dealt before they become runs, joined without broadcasts and without a second shuffle."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from trialmill.functions import toolcalls as tc
from trialmill.functions.text import judge_score, strip
from trialmill.operators import scoring
from trialmill.plans import bindings as b
from trialmill.session import shares


def _plan(spark, sf_dir, name):
    return entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cpstc", "analysis_base", "rescore_tools", "result_cube", "best_sequence_f1", "unscored_runs",
                                  "pending_runs", "partial_update_scores", "missing_gold"])
def test_sides_that_grow_are_not_broadcast(spark, sf_dir, name):
    assert not re.search(r"BroadcastHashJoin \[[^\]]*(task_id|run_id)", _plan(spark, sf_dir, name))


@pytest.mark.parametrize("name", ["cpstc", "analysis_base", "score_summary", "unscored_runs", "mcnemar_exact"])
def test_rows_of_a_task_are_shuffled_once(spark, sf_dir, name):
    again = re.findall(r"Exchange hashpartitioning\([^)]*(?:task_id|run_id)[^)]*\), ENSURE_REQUIREMENTS", _plan(spark, sf_dir, name))
    assert not again


def test_tasks_are_dealt_by_stored_bytes(spark, tmp_path, monkeypatch):
    spark.range(40_000).selectExpr("id AS event_id", "id % 50 AS user_id", "'view' AS event_type", "1.5D AS value",
                                   "concat('{\"k\": ', id % 90, '}') AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    table = b.table(spark, str(tmp_path), "events")
    assert shares(table) == spark.sparkContext.defaultParallelism and shares(table, 1000) > 40
    monkeypatch.setattr(b, "shares", lambda t: shares(t, 10_000))
    sizes = [r[0] for r in b.tasks(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 3 * 40_000 / shares(table, 10_000)


def test_formulas_are_worked_out_once(spark, sf_dir):
    assert "md5" not in _plan(spark, sf_dir, "unscored_runs")
    assert _plan(spark, sf_dir, "fig_fidelity_model").count("regexp_extract_all") == 1


def test_calls_in_one_pass_equal_two(spark):
    texts = ["TOOL_CALL: read_file( a )", "tool_Call:x(y)TOOL_CALL: \u00c4b\u0130 \u2003( (p, q) )", "TOOL_CALL: a()", "TOOL_CALL: a b(c)",
             "TOOL_CALL:\n\tz9_\x0b\n(\n k \n)\nTOOL_CALL: w(unclosed", "", None, "TOO\u2113_CALL: a(b) tool_call: RUN_TESTS (x)"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    plain = F.lit(r"(?iU)TOOL_CALL:\s*(\w+)\s*\(([^)]*)\)")
    two = F.zip_with(F.regexp_extract_all("t", plain, F.lit(1)), F.regexp_extract_all("t", plain, F.lit(2)),
                     lambda n, p: F.struct(F.lower(n).alias("tool"), strip(p).alias("params")))
    one = F.transform(tc.extract_tool_calls(F.col("t")), lambda c: F.struct(c["tool"], c["params"]))
    for row in frame.select(two.alias("x"), one.alias("y")).collect():
        assert (row.x is None and row.y is None) or [tuple(c) for c in row.x] == [tuple(c) for c in row.y]


def test_a_reply_is_parsed_once(spark, sf_dir):
    plan = spark.range(1).select(judge_score(F.col("id").cast("string"))[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("schema_of_variant") == 1


def test_candidates_are_made_ready_before_the_join(spark, sf_dir):
    """Distinct names of a candidate sequence are counted once a task, not in every run of it."""
    plan = _plan(spark, sf_dir, "first_call_correct")
    assert plan.count("array_distinct(lambda") == 1 and "array_distinct" not in plan[:plan.index("SortMergeJoin")].replace("array_distinct(_names", "")


def test_scores_with_prepared_candidates_equal_those_without(spark):
    names = [None, [], ["a"], ["b", "a", "a"], ["c", "d"], ["a", None, "b"]]
    golds = [(["a", "b"], [["b"], [], ["a", "c", "c"]]), ([], []), (None, None), (["c"], [["d", "c"], None]), (["a", None], [["x"]])]
    rows = [(i * 10 + j, n, e, a, ["a"]) for i, n in enumerate(names) for j, (e, a) in enumerate(golds)]
    frame = spark.createDataFrame(rows, "i int, tool_names array<string>, expected_tools array<string>, "
                                        "alternative_tool_sequences array<array<string>>, minimum_required_tools array<string>")
    plain = scoring.with_sequence_scores(frame)
    ready = scoring.with_sequence_scores(scoring.with_candidates(frame))
    assert plain.columns == ready.columns and sorted(map(str, plain.collect())) == sorted(map(str, ready.collect()))
    best = {r.i: (r.tool_f1, r.first_call_correct) for r in plain.collect()}
    assert best[30] == (1.0, 0) and best[20] == (0.6667, 1) and best[40] == (0.5, 0) and best[43] == (1.0, 0)


@pytest.mark.parametrize("name", [
    "analysis_base_counts", "anova_by_intent", "best_sequence_f1_counts", "bootstrap_cpstc_cover", "fig_hallucination",
    "fig_pareto", "fig_success", "fig_token_scatter", "hallucination_deltas", "rescore_tools_counts", "mcnemar_hallucination",
    "mean_ci95", "model_stratified", "relative_lift"])
def test_gold_is_not_sent_to_the_driver(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "SortMergeJoin [task_id" in plan and not re.search(r"BroadcastHashJoin \[[^\]]*(task_id|run_id)", plan)
