"""Documents to training shards: quality, near-duplicates, benchmark, mix, shards."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from trialmill.llm import decontam, mixing, neardup, quality, sharding
from trialmill.session import shared_dir

SHARDS = 64


#: Columns that the stages read.
READ = ("doc_id", "text", "lang", "source")


def keeps_columns(stage):
    """The stage with all other columns under names of their own, so that none meets a name the stage adds."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c.lower() in READ else f"__input_{i}" for i, c in enumerate(docs.columns)]
        done = stage(spark, docs.toDF(*inside), sf_dir)
        return done.select(*inside).toDF(*docs.columns)

    return run


@keeps_columns
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; it learns from the labelled ones among them."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return neardup.keep_one(docs)


@keeps_columns
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target weight asks for."""
    return mixing.repeat_rows(mixing.pareto_mix(docs)).select(*docs.columns)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.place(docs, sharding.shard_names(SHARDS))


STAGES = [
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The stages fit models and compare texts with a fuzzy measure, which SQL does not state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
