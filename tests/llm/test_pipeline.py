"""The pipeline on a planted fixture and on the given tables."""

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept and kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "sharding":
            assert after.columns == columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert len(kept) <= before.count()
        if name == "near_duplicates":
            assert len(kept) < before.count() and max(Counter(r.doc_id for r in after.collect()).values()) == 1
        before = spark.createDataFrame(after.collect(), after.schema)
    assert before.columns == [*columns, "slot", "shard"]
    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, before.collect()))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_queries_return_whole_tables(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    table = {"op5": "embeddings", "op6": "pages", "op4": None}.get(name.split("_")[0], "documents")
    if table == "embeddings":
        assert got.select("query_id").distinct().count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").count()
    elif table:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    else:
        assert got.count() > 0
