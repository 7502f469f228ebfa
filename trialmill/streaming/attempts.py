"""The last attempt of every run, kept in streaming state.

State knows the last attempt of each run.  When a greater version arrives, what the earlier one had added to the
sums of its group is taken back and the new one is added; replays and late, older attempts change nothing.  Each
micro-batch stores its changes in a folder of its own, which a replay overwrites, so a reader adds up a few rows for each
batch and never reduces attempts again.

A state key is a bucket of runs, since a call for a key takes milliseconds whatever it does; its runs are whole columns in state
and are replaced by array operations, not one by one.  Runs without a new attempt for
`idle` are final and leave their bucket when it is next touched; an attempt that comes still later counts as a run
of its own.  (Spark's processing-time time-outs would keep an available-now query running for ever.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 512
IDLE_MS = 30 * 24 * 3600 * 1000
#: Attempts of a bucket that are taken in at once, at least.
TAKEN_IN = 100_000


def take_in(held: pa.Table, arrived: pa.Table, key: str, version: str) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Last attempts after `arrived`, the attempts that were added to them, and those of `held` that gave way.

    The greatest version of a key counts, the earliest of equal ones; `held` has one row a key.
    """
    both = pa.concat_tables([held, arrived]).combine_chunks()
    run = pc.dictionary_encode(both[key]).combine_chunks().indices.to_numpy()
    # ~x turns the order of whole numbers round without an overflow; equal ones stay in the order they came.
    order = np.lexsort((~both[version].to_numpy(), run))
    first = np.ones(len(order), dtype=bool)
    first[1:] = run[order[1:]] != run[order[:-1]]
    kept = np.zeros(len(order), dtype=bool)
    kept[order[first]] = True
    n = held.num_rows
    return both.filter(pa.array(kept)), arrived.filter(pa.array(kept[n:])), held.filter(pa.array(~kept[:n]))


def attempt_changes(attempts: DataFrame, key: str, version: str, group: list[str], measures: list[str],
                    buckets: int = BUCKETS, idle: int = IDLE_MS) -> DataFrame:
    """Stream of attempts -> stream of (group, n, measures) to add: negative where an attempt was replaced.

    Measures are whole numbers, NULL counts as 0; attempts without key or version are left out.
    """
    columns = [key, version, *group, *measures]

    def update(bucket, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        last = layout.empty_table()
        if state.exists:
            last = pa.ipc.open_stream(state.get[0]).read_all()
            last = last.filter(pc.less_equal(pc.subtract(pa.scalar(now), last["_seen"]), idle))
        changes, waiting, n = [], [], 0

        def settle_waiting() -> None:
            nonlocal last, waiting, n
            last, added, gone = take_in(last, pa.concat_tables(waiting), key, version)
            for rows, sign in ((added, 1), (gone, -1)):
                sums = [pc.multiply(rows[m], sign) for m in measures]
                changes.append(pa.table([*[rows[g] for g in group], pa.repeat(pa.scalar(sign, pa.int64()), rows.num_rows), *sums], schema=changed))
            waiting, n = [], 0

        for frame in frames:
            rows = pa.Table.from_pandas(frame[columns].assign(_seen=now), layout, preserve_index=False)
            waiting, n = [*waiting, rows], n + rows.num_rows
            if n >= max(TAKEN_IN, last.num_rows):
                settle_waiting()
        if waiting:
            settle_waiting()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, layout, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(last)
        state.update((sink.getvalue().to_pybytes(),))
        names = ["n", *measures]
        sums = pa.concat_tables([changed.empty_table(), *changes]).group_by(group).aggregate([(c, "sum") for c in names])
        rows = sums.select([*group, *[f"{c}_sum" for c in names]]).rename_columns([*group, *names]).to_pandas()
        rows = rows[(rows[names] != 0).any(axis=1)]
        if len(rows):
            yield rows

    plain = attempts.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(
        key, F.col(version).cast("long"), *group, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in measures],
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"))
    out = T.StructType([attempts.schema[c] for c in group] + [T.StructField(c, T.LongType()) for c in ("n", *measures)])
    state = T.StructType([T.StructField("last", T.BinaryType())])
    layout = to_arrow_schema(T.StructType([*plain.drop("_bucket").schema, T.StructField("_seen", T.LongType())]))
    layout = pa.schema([field.with_nullable(True) for field in layout])
    changed = to_arrow_schema(out)
    changed = pa.schema([field.with_nullable(True) for field in changed])
    return plain.groupBy("_bucket").applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)


def store_changes(changes: DataFrame, group: list[str], measures: list[str], out: str, checkpoint: str) -> None:
    """Store the changes of everything that has arrived and stop; the next call goes on from there."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", *measures)])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        changes.writeStream.outputMode("update").foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_sums(spark: SparkSession, out: str, group: list[str], measures: list[str]) -> DataFrame:
    """Runs and sums of each group by last attempts; groups that all runs have left are gone."""
    total = spark.read.parquet(f"{out}/batch=*").groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", *measures)])
    return total.where("n <> 0")
