"""The way beyond the broadcast limit: the same results when every join has to shuffle."""

import pytest

import __spark_entry__ as entry_point
from trialmill import session

NAMES = ["tasks_master", "best_sequence_f1", "rule_check", "lloyd_step", "cluster_representatives",
         "silhouette_exact", "intent_preservation", "score_summary"]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(session.small_side, "__defaults__", (-1,))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    if adaptive is None:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    else:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)


def result(spark, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def broadcast_results(spark, sf_dir):
    return {name: result(spark, sf_dir, name) for name in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_same_without_broadcast(spark, sf_dir, broadcast_results, no_broadcast, name):
    plan = entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert result(spark, sf_dir, name) == broadcast_results[name]
