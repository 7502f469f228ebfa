"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks; a task scores one block against another with a matrix
product of whole numbers.  Round by round every tile counts its scores in bins of a per-query range,
Spark adds the counts up, and the bin that holds the k-th score becomes the next range, until it is
one score wide.  A last pass keeps what is above it and, of the ties, the smallest ids.  A tile only
reports bins from that of its own k-th score upwards: lower ones cannot hold the k-th of all.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do
rows without id; a shorter vector counts as zero where it ends; candidates with the query's own id
are left out; repeated query rows are one query, repeated candidate rows all count; fewer than k
candidates are returned as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialmill.llm.common import cut_lineage

K = 10
SCALE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
BINS = 4096
#: The search runs between these bounds; scores beyond them count as the bound until the last step takes them as they are.
LIMIT = 2**61
LONGEST = 2**63 - 1
PACKED = "block long, ids array<long>, data binary, dim int"


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int, is_query: Column) -> DataFrame:
    """(vec_id, v, asked): every component x becomes floor(scale * x)."""
    usable = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return rows.where(usable).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            ids, lists = part.column(0).to_numpy(), part.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            dim = int(lengths.max(initial=0))
            data = np.zeros((part.num_rows, dim), np.int64)
            data[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[0])]), pa.array([ids], pa.list_(pa.int64())), pa.array([data.tobytes()]), pa.array([dim], pa.int32())],
                names=["block", "ids", "data", "dim"],
            )


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim) if dim else np.zeros((0, 0), np.int64)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact doubles where every sum fits in 53 bits, else longs; beyond a long its ends."""
    dim = min(queries.shape[1], candidates.shape[1])
    q, c = queries[:, :dim], candidates[:, :dim]
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * dim
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**63:
        return q @ c.T
    about = q.astype(np.float64) @ c.T.astype(np.float64)
    return np.where(about >= 2.0**63, LONGEST, np.where(about < -(2.0**63), -LONGEST - 1, q @ c.T))


def _tile(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores, and where a candidate is the query itself."""
    qid, cid = np.asarray(row.q_ids, np.int64), np.asarray(row.ids, np.int64)
    q = _matrix(row.q_data, row.q_dim) if row.q_dim else np.zeros((len(qid), 0), np.int64)
    c = _matrix(row.data, row.dim) if row.dim else np.zeros((len(cid), 0), np.int64)
    return qid, cid, scores(q, c), qid[:, None] == cid[None, :]


def _histogram(k: int, bins: int, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                qid, _, score, own = _tile(row)
                at = (np.clip(score, -LIMIT, LIMIT) - np.asarray(row.lows, np.int64)[:, None]) // width
                at = np.where(own | (at < 0), -1, np.minimum(at, bins))  # above the range: bin `bins`
                if at.shape[1] > k:
                    kth = np.partition(at, at.shape[1] - k, axis=1)[:, -k]
                    at = np.where(at < kth[:, None], -1, at)
                line, column = np.nonzero(at >= 0)
                flat, n = np.unique(line * (bins + 1) + at[line, column], return_counts=True)
                yield pd.DataFrame({"query_id": qid[flat // (bins + 1)], "bin": flat % (bins + 1), "n": n})

    return run


def _select(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                qid, cid, score, own = _tile(row)
                floor = np.asarray(row.lows, np.int64)[:, None]
                held = np.clip(score, -LIMIT, LIMIT)
                # at the bounds the search cannot tell scores apart, so all of them go on
                above = ((held > floor) | ((held == floor) & (np.abs(floor) == LIMIT))) & ~own
                ties = (held == floor) & ~own & ~above
                order = np.argsort(cid, kind="stable")
                rank = np.cumsum(ties[:, order], axis=1)
                first = np.zeros_like(ties)
                first[:, order] = ties[:, order] & (rank <= k)
                line, column = np.nonzero(above | first)
                yield pd.DataFrame({"query_id": qid[line], "vec_id": cid[column], "score": score[line, column]})

    return run


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    bins: int = BINS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query among all other rows."""
    vectors = whole_vectors(rows, vec_id, vector, scale, is_query)
    packed = cut_lineage(vectors.select("vec_id", "v").mapInArrow(lambda b: _pack(b, candidate_block), PACKED))
    queries = vectors.where("asked").dropDuplicates(["vec_id"]).select("vec_id", "v")
    asked = cut_lineage(queries.mapInArrow(lambda b: _pack(b, query_block), PACKED).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim")
    ))
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    reach = min(int(vectors.agg(F.max(norm)).first()[0] or 0) + 1, LIMIT)  # beyond any product, by Cauchy-Schwarz
    width = -(-(2 * reach + 1) // bins)
    state = asked.select("q_block", F.posexplode("q_ids").alias("pos", "query_id"), F.lit(-reach).cast("long").alias("low"))
    while True:
        tiles = _tiles(packed, asked, state)
        counts = tiles.mapInPandas(_histogram(k, bins, width), "query_id long, bin long, n long")
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        running = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        found = running.where(F.col("upto") >= k).groupBy("query_id").agg(F.max("bin").alias("bin"))
        # with fewer than k candidates the range stays below all of them
        moved = F.col("low") + F.coalesce("bin", F.lit(0)) * width
        state = cut_lineage(state.join(found, "query_id", "left").select("q_block", "pos", "query_id", moved.alias("low")))
        if width == 1:
            break
        width = -(-width // bins)
    kept = _tiles(packed, asked, state).mapInPandas(_select(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tiles(packed: DataFrame, asked: DataFrame, state: DataFrame) -> DataFrame:
    """Every query block, with its ranges, beside every candidate block."""
    lows = state.groupBy(F.col("q_block").alias("_q")).agg(F.array_sort(F.collect_list(F.struct("pos", "low"))).alias("_lows"))
    ranged = asked.join(lows, F.col("q_block") == F.col("_q")).select("q_ids", "q_data", "q_dim", F.col("_lows.low").alias("lows"))
    return packed.select("ids", "data", "dim").join(ranged, F.lit(True))
