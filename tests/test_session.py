"""Tables in the shared folder: kept while they are read, gone with their scope."""

import os

from trialmill.session import cut_lineage, forget, scratch, shared_dir


def _written(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("trialmill-cut-")}


def test_scratch_tables_go_with_their_scope(spark):
    before = _written(spark)
    kept = cut_lineage(spark.range(10))
    with scratch(spark):
        inner = cut_lineage(kept.selectExpr("id * 2 AS id"))
        with scratch(spark):
            cut_lineage(inner)
        assert inner.count() == 10 and len(_written(spark) - before) == 2
        result = cut_lineage(inner).count()
    assert result == 10 and kept.count() == 10 and len(_written(spark) - before) == 1
    forget(kept, None, spark.range(3))
    assert _written(spark) == before


def test_scope_ends_with_an_error(spark):
    before = _written(spark)
    try:
        with scratch(spark):
            cut_lineage(spark.range(3))
            raise KeyError
    except KeyError:
        pass
    assert _written(spark) == before
