"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of all shingles.  Each of the 64 bits
gets a non-zero vector of radius + 1 bits; table t (again such a vector) keeps the bits whose vector
has an odd inner product with t.  For any `radius` differing bits there is a t orthogonal to all
their vectors, so every pair within the radius agrees in some table: nothing is missed.

Copies fold into one fingerprint first.  A bucket is read as a sorted stream; its links are a spanning
forest, never all its pairs.  Buckets with over `BUCKET` fingerprints are cut again by a second
family of masks with the same guarantee: what is left then agrees in all but about 16 bits, which
bounds a group by the number of values of those bits, however many documents there are.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; repeated rows share everything; a component without any doc_id has a null
component_id; an empty table stays empty; columns that clash with added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import cut_lineage, fresh, shielded, utf8
from trialmill.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def covering_masks(radius: int = RADIUS, multiplier: int = 1, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; any `radius` positions are all outside of at least one of them."""
    full = 2 ** (radius + 1) - 1
    vectors = [(i * multiplier + i // full) % full + 1 for i in range(bits)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, full + 1)]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half the hashes have set."""
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, th, fp) of every row; fp holds the 64 bits as a long, th is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th bigint, fp bigint")


def group_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the values (distinct) that differ in at most `radius` bits."""
    out, rest = [], values
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            found = rest[near]
            if len(found):
                out.extend((at, x) for x in found)
                frontier.extend(found)
                rest = rest[~near]
    return out


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Links inside each run of equal keys; runs of two go at once."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
    two = starts[sizes == 2]
    close = np.bitwise_count(values[two] ^ values[two + 1]) <= radius
    parts = [np.stack((values[two[close]], values[two[close] + 1]), axis=1)]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if found := group_links(values[start : start + size], radius):
            parts.append(np.array(found, np.uint64))
    return np.concatenate(parts)


def _stream_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k, v):
            links = bucket_links(k, v, radius).view(np.int64) if len(k) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            values = np.concatenate((values, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            yield emit(keys[:cut], values[:cut])
            keys, values = keys[cut:], values[cut:]
        yield emit(keys, values)

    return run


def _tables(points: DataFrame, masks: list[int], *keep: str) -> DataFrame:
    """A row for each mask; `key` is a hash of the table, of what was kept before and of the masked bits."""
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m))), *[F.col(c) for c in keep]) for t, m in enumerate(masks)]
    return points.select("fp", F.explode(F.array(*keys)).alias("key"))


def fingerprint_links(points: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Distinct `fp` -> (a, b) links whose components are those of all pairs within `radius` bits."""
    rows = _tables(points, covering_masks(radius))
    large = cut_lineage(rows.groupBy("key").count().where(F.col("count") > bucket).select(F.col("key").alias("_key")))
    small = rows.join(large, F.col("key") == F.col("_key"), "left_anti")
    again = _tables(
        rows.join(large, F.col("key") == F.col("_key"), "left_semi").withColumnRenamed("key", "first"),
        covering_masks(radius, multiplier=7), "first",
    )
    # distinct keys of both levels are apart but for hash collisions, which only add candidates
    buckets = small.unionByName(again)
    return buckets.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(
        _stream_links(radius), "a bigint, b bigint"
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    prints = cut_lineage(fingerprints(docs, shingle, seed))
    points = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(points.select("fp"), radius, bucket))
    rooted = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "th", "fp", "root", "component_id")


def hex_print(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates.

    The row with the smallest doc_id stays, a row without one only where its group has none; texts
    under one id are ordered by their hash, and of equal rows one stays.
    """
    return keep_rows(docs, near_duplicates(docs, **options))


@shielded("doc_id", "text")
def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that `keep_one` keeps where `found` (doc_id, th, root) has the groups."""
    found = cut_lineage(found.select("doc_id", "th", "root"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    kept = found.groupBy("root").agg(F.min(order).alias("_best")).select(F.col("_best.doc_id").alias("_doc"), F.col("_best.th").alias("_th"))
    again = cut_lineage(found.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_th"))
    rows = docs.join(kept, same, "left_semi")
    if not again.take(1):
        return rows
    once = rows.join(again, same, "left_anti")
    mark = fresh(docs, "_row_text")
    repeated = rows.join(again, same, "left_semi").withColumn(mark, F.xxhash64("text"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", mark]).drop(mark))
