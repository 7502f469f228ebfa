"""Filter interaction audit as an incremental stream with retractions.

Five filters judge every document (A few words, B few distinct words, C capitals, D symbols, E a copy of
a text with a smaller doc_id); what a filter removes, and what others would have removed as well, depends on the order in
which they run.  All orders follow from how many documents of a part have each mask of failed filters.

The files run through available-now micro-batches.  A to D depend on the text alone; E depends on texts that may
come later, so state is kept by text: the smallest id so far and what its rows were counted as.  When a
smaller id arrives, the counts of the earlier one are retracted and given again with E.  The counters of a batch go
to a folder of its own, which a replay overwrites; their sum is the answer however files fall into batches.

A hot text folds to a row for each part and label in every task before it is shuffled; state holds a number of rows,
never the rows.  A state store key is a bucket of texts; there are as many as the files have megabytes, so a
bucket does not grow with the table.  The state store is the session's (`spark.sql.streaming.stateStore.providerClass`).

Defined cases: a null text is empty and a null lang the empty part; a null doc_id has no smaller one and is none, so
its row never fails E; rows that repeat an id with one text are no copies of each other; of an id's repeated labels
one 1 counts; columns of other names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import pickle
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialmill.llm.common import cut_lineage, join_written, utf8
from trialmill.session import inline_table, planned_bytes, remove_folders, shared_dir

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
FEW_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 4
#: Texts are kept in buckets, one for each such piece of the files, as a call for a key takes 2 ms whatever it does.
BUCKET_BYTES = 1024 * 1024
MIN_BUCKETS = 64


def text_mask(text: bytes) -> int:
    """Which of A to D a text fails, as bits."""
    words = text.split()
    points = sum(1 for _ in text.decode()) if not text.isascii() else len(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < FEW_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITALS_PERCENT * points) << 2
        | bool(SYMBOLS.search(text)) << 3
    )


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, n) of all rows; a task's equal rows are one, at least within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[tuple, int] = {}
            masks: dict[bytes, int] = {}
            for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                digest = xxhash.xxh3_128_digest(text)
                if digest not in masks:
                    masks[digest] = text_mask(text)
                key = (doc, part, digest)
                count[key] = count.get(key, 0) + 1
            columns = list(zip(*count)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()),
                 pa.array([masks[d] for d in columns[2]], pa.int32()), pa.array(count.values(), pa.int64())],
                names=["doc_id", "part", "digest", "mask", "n"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int, n bigint")


FOLDED = "digest binary, part string, mask int, good boolean, toxic boolean, has boolean, least {kind}, n_least bigint, n_more bigint, n_none bigint"


def _folded(rows: DataFrame, kind: str) -> DataFrame:
    """A row for each text, part and label of a task's batch: the smallest id, rows that have it, a larger one, or none."""
    filler = "" if kind == "string" else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list] = {}
            names = ("doc_id", "part", "digest", "mask", "n", "good", "toxic")
            for doc, part, digest, mask, n, good, toxic in zip(*[batch.column(c).to_pylist() for c in names]):
                entry = held.setdefault((digest, part, mask, good, toxic), [False, filler, 0, 0, 0])
                if doc is None:
                    entry[4] += n
                elif not entry[0] or doc < entry[1]:
                    entry[:4] = [True, doc, n, entry[3] + entry[2]]
                elif doc == entry[1]:
                    entry[2] += n
                else:
                    entry[3] += n
            columns = list(zip(*[(*key, *entry) for key, entry in held.items()])) or [()] * 10
            types = [pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), batch.column("doc_id").type, *[pa.int64()] * 3]
            names = ["digest", "part", "mask", "good", "toxic", "has", "least", "n_least", "n_more", "n_none"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, FOLDED.format(kind=kind))


DELTA = "part string, mask int, good boolean, toxic boolean, n bigint"


def _update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New rows of a bucket's texts -> changes of the counters.

    State: for each text the smallest id and how many of its rows were counted under each (part, good, toxic).
    """
    texts: dict[bytes, tuple] = pickle.loads(state.get[0]) if state.exists else {}
    change: dict[tuple, int] = {}

    def add(part, mask, good, toxic, n):
        at = (part, mask, good, toxic)
        change[at] = change.get(at, 0) + n

    for frame in frames:
        for digest, part, mask, good, toxic, has, lowest, n_least, n_more, n_none in zip(*[
            frame[c].tolist() for c in ("digest", "part", "mask", "good", "toxic", "has", "least", "n_least", "n_more", "n_none")
        ]):
            add(part, mask, good, toxic, n_none)
            add(part, mask | COPY, good, toxic, n_more)
            least, held = texts.get(digest, (None, {}))
            if not has:
                continue
            if least is None or lowest < least:
                for (part0, good0, toxic0), n in held.items():  # they are copies of the newcomer
                    add(part0, mask, good0, toxic0, -n)
                    add(part0, mask | COPY, good0, toxic0, n)
                texts[digest] = lowest, {(part, good, toxic): n_least}
            elif lowest == least:
                held[part, good, toxic] = held.get((part, good, toxic), 0) + n_least
            add(part, mask if least is None or lowest <= least else mask | COPY, good, toxic, n_least)
    state.update((pickle.dumps(texts),))
    rows = [(*at, n) for at, n in change.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


def flagged(labels: DataFrame) -> DataFrame:
    """(_doc, _good, _toxic) of the ids with a label of 1."""
    ones = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    return ones.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )


def mask_counters(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters they fail and their labels.

    `path` holds Parquet documents (doc_id, text, lang).  Without `files_per_batch` the files make up to BATCHES
    micro-batches.
    """
    table = spark.read.parquet(path)
    files = files_per_batch or max(1, -(-len(table.inputFiles()) // BATCHES))
    kind = table.schema["doc_id"].dataType.simpleString()
    marks = cut_lineage(flagged(labels))
    folder = f"{shared_dir(spark)}/trialmill-audit-{uuid.uuid4().hex}"

    # as a pattern the path may be one file as well as a folder of files
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
    judged = join_written(_judged(docs), marks, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"),
    )
    buckets = max(MIN_BUCKETS, planned_bytes(table) // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    held = T.StructType([T.StructField("texts", T.BinaryType())])
    changes = _folded(judged, kind).select("*", bucket).groupBy("bucket").applyInPandasWithState(
        _update, T.StructType.fromDDL(DELTA), held, "update", GroupStateTimeout.NoTimeout
    )

    def store(batch: DataFrame, number: int) -> None:
        total = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    # a table without files gives no batch
    spark.createDataFrame([], DELTA).write.parquet(f"{folder}/counters/batch=-1")
    query = (
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()
    every = spark.read.schema(DELTA).parquet(f"{folder}/counters")
    counters = cut_lineage(every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))
    remove_folders(spark, [folder])
    return counters


def orders(spark: SparkSession) -> DataFrame:
    """What becomes of a document with a mask at each step of each order: 32 * 120 * 5 rows, from the rules."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            for mask in range(1 << len(FILTERS)):
                fails, earlier = bool(mask & bit), bool(mask & before)
                rows.append((
                    mask, "".join(order), step, int(not mask & (before | bit)), int(fails and not earlier), int(fails and earlier),
                    int(mask == bit), 120 // mask.bit_count() if fails else 0,
                ))
            before |= bit
    counts = ["kept", "removed", "redundant", "unique_fails", "shapley"]
    fields = [T.StructField("_mask", T.IntegerType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    return inline_table(spark, T.StructType(fields + [T.StructField(f"_{c}", T.LongType()) for c in counts]), rows)


def filter_orders(counters: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    joined = counters.join(F.broadcast(orders(counters.sparkSession)), F.col("mask") == F.col("_mask"))
    lost = F.col("n") * F.col("_removed")
    return joined.groupBy("part", "filter_order", "step").agg(
        *[F.sum(F.col("n") * F.col(f"_{c}")).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        F.sum(F.when(F.col("good"), lost).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("toxic"), lost).otherwise(0)).alias("toxic_lost"),
        F.sum(F.col("n") * F.col("_shapley")).alias("shapley"),
    )
