"""Growing sides while a query runs: stored parts and final plans send none of them to the driver; runs come after the deal."""

import re

import pytest

import __spark_entry__ as entry_point
from trialmill.operators import inference, resample, tables
from trialmill.plans import bindings as b

GROWING = re.compile(r"BroadcastHashJoin \[[^\]]*(task_id|run_id)")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cpstc", "fig_success", "mean_ci95", "rescore_tools", "relative_lift", "fig_hallucination"])
def test_joins_stay_out_of_broadcasts_at_run_time(spark, sf_dir, name):
    """Adaptive execution sees small tables here and would broadcast them if it might."""
    got = entry_point.queries()[name](spark, sf_dir)
    got.collect()
    final = _plan(got).split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and "SortMergeJoin" in final and not GROWING.search(final)


@pytest.mark.parametrize("name, module, step", [
    ("describe_metric", inference, "cut_lineage"), ("bootstrap_cpstc_cover", resample, "cut_lineage"), ("bucketed_analysis", tables, "bucketed")])
def test_stored_parts_stay_out_of_broadcasts(spark, sf_dir, monkeypatch, name, module, step):
    plans, store = [], getattr(module, step)

    def stored(df, *more):
        plans.append(_plan(df))
        return store(df, *more)

    monkeypatch.setattr(module, step, stored)
    entry_point.queries()[name](spark, sf_dir).collect()
    joins = [p for p in plans if "SortMergeJoin [task_id" in p]
    assert joins and not any(GROWING.search(p) for p in plans)


@pytest.mark.parametrize("name", ["redundant_calls", "upsert_results", "format_compliance", "rule_check"])
def test_runs_are_derived_after_the_deal(spark, sf_dir, monkeypatch, name):
    """A row group is read by one task; only slim events pass through it, in 23 shares from here on."""
    monkeypatch.setattr(b, "shares", lambda table: 23)
    plan = _plan(entry_point.queries()[name](spark, sf_dir))
    dealt = [m.start() for m in re.finditer(r"Exchange hashpartitioning\(task_id[^)]*, 23\), REPARTITION_BY_NUM", plan)]
    derived = [m.start() for m in re.finditer(r"Generate explode\(\[m0", plan)]
    assert len(dealt) == len(derived) > 0 and all(d < e for d, e in zip(derived, dealt))


def test_upserts_leave_the_dealt_run_log_in_place(spark, sf_dir, monkeypatch):
    """Only the keys that were replaced move, to where their tasks are; they are found without a shuffle of their own."""
    plans, store = [], tables.cut_lineage
    monkeypatch.setattr(tables, "cut_lineage", lambda df: plans.append(_plan(df)) or store(df))
    plans.append(_plan(entry_point.queries()["upsert_results"](spark, sf_dir)))
    moved = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE_REQUIREMENTS", "\n".join(plans))
    assert len(moved) == 1 and re.fullmatch(r"_task_id#\d+", moved[0])


def test_upsert_where_rows_are_dealt_equals_the_plain_one(spark):
    schema = "task_id string, run_id string, version int, note string"
    stored = spark.createDataFrame([("t1", "r1", 1, "a"), ("t1", None, 1, "b"), ("t2", "r2", 1, None), ("t3", "r3", 1, "d")], schema)
    new = spark.createDataFrame([("t1", None, 2, "e"), ("t1", None, 3, None), ("t2", "r2", 2, "f"), ("t4", "r4", 2, "g")], schema)
    dealt = tables.upsert(stored.repartition(5, "task_id"), new, ["run_id"], "version", dealt_by="task_id")
    got = sorted(map(str, dealt.select(*stored.columns).collect()))
    assert got == sorted(map(str, tables.upsert(stored, new, ["run_id"], "version").select(*stored.columns).collect()))
    assert len(got) == 5 and "Row(task_id='t1', run_id=None, version=3, note=None)" in got
