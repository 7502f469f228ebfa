"""Scoring a run log while it is being written.

The score table is a log of batches: `batch=<id>/` holds the rows one micro-batch scored.
Rewriting a replayed batch replaces its own folder, so delivery is exactly once without
rewriting the table.  Readers take the last version per run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.tables import keep_last


def score_stream(runs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Score everything that has arrived and stop; the next call goes on from there."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        score(batch).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")

    query = (
        runs.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_scores(spark: SparkSession, out: str, keys: list[str], version: list[str]) -> DataFrame:
    """Current scores: the last attempt per run over all batches."""
    return keep_last(spark.read.parquet(f"{out}/batch=*"), keys, version)


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files called `name` in `folder` (or below `folder/name`)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path) and system.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def running_summary(runs: DataFrame, keys: list[str], aggregates: list, out: str, checkpoint: str) -> None:
    """Streaming aggregate in complete mode; every batch writes the summary anew in a folder of its own,
    so a reader always finds a finished one."""
    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        runs.groupBy(*keys).agg(*aggregates).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """The summary of the newest batch."""
    every = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    newest = every.agg(F.max("batch").alias("batch"))
    return every.join(newest, "batch", "left_semi").drop("batch")
