"""Frontier against all pairs of rows, joins of stored buckets without a shuffle, all result tables in one pass."""

import random

import pytest

from trialmill.operators import grid, reports
from trialmill.operators.frontier import frontier
from trialmill.operators.tables import bucketed


def _points(n=600, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *[k / 8 for k in range(20)]])) for i in range(n)]
    return rows + rows[:20] + [(n, "a", 3, float("nan")), (n + 1, "lone", 5, 0.0)]


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_frontier_equals_all_pairs(spark, ranges):
    rows = _points()
    whole = [r for r in rows if r[2] is not None and r[3] is not None and r[3] == r[3]]
    want = [r for r in whole if not any(
        o[1] == r[1] and o[2] <= r[2] and o[3] >= r[3] and (o[2] < r[2] or o[3] > r[3]) for o in whole)]
    frame = spark.createDataFrame(rows, "run long, intent string, cost long, quality double")
    got = [tuple(r) for r in frontier(frame, ["intent"], "cost", "quality", ranges).collect()]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 4
    assert frontier(frame.limit(0), ["intent"], "cost", "quality").count() == 0


def test_frontier_without_keys(spark):
    frame = spark.createDataFrame([(1, 5, 0.5), (2, 3, 0.5), (3, 9, 0.9), (4, 3, 0.4)], "run long, cost long, quality double")
    assert sorted(r.run for r in frontier(frame, [], "cost", "quality").collect()) == [2, 3]


def _exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_stored_buckets_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = spark.range(3000).selectExpr("concat('r', id) AS run_id", "id % 7 AS tokens", "IF(id % 11 = 0, 'bad', NULL) AS error")
        scores = spark.range(0, 3000, 2).selectExpr("concat('r', id) AS run_id", "id AS score")
        left, right = bucketed(runs, "run_id", 8), bucketed(scores, "run_id", 8)
        joined = reports.analysis_base(left, right)
        assert _exchanges(joined) == 0 and joined.count() == 1500
        pending = grid.pending_runs(bucketed(scores, "run_id", 8), left)
        assert _exchanges(pending) == 0 and pending.count() == len([i for i in range(0, 3000, 2) if i % 11 == 0])
        assert _exchanges(reports.analysis_base(runs, scores)) > 0
        assert _exchanges(left.groupBy("run_id").count()) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_result_cube_equals_its_tables(spark):
    rng = random.Random(4)
    columns = list(dict.fromkeys(reports.OVERALL[n] for n in reports.STRATIFIED if n != "func_correct_rate"))
    rows = [(rng.choice(["m", None]), rng.choice("xyz"), rng.choice("abc"), rng.random() < 0.5, *[rng.randrange(0, 2) for _ in columns]) for _ in range(300)]
    types = ", ".join(f"{c} {'long' if c in ('min_req_met', 'total_tokens') else 'double'}" for c in columns)
    rows = [(*r[:4], *[v if c in ("min_req_met", "total_tokens") else float(v) for v, c in zip(r[4:], columns)]) for r in rows]
    frame = spark.createDataFrame(rows, f"model string, intent string, condition string, functional_correct boolean, {types}")
    cube = reports.result_cube(frame)
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") <= 2 and cube.select("level").distinct().count() == len(reports.CUBE)
    for level, keys in ((6, ["condition"]), (2, ["model", "condition"]), (4, ["intent", "condition"]), (3, ["model"])):
        part = cube.where(f"level = {level}").select(*keys, *reports.STRATIFIED)
        want = reports.stratified(frame, keys)
        text = lambda df: sorted(map(str, df.collect()))
        assert text(part) == text(want)
    assert cube.where("level = 7").first()["n"] == 300
