"""What the corpus operators share: words, hashes, chunks of texts, joins with small tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trialmill.session import cut_lineage

#: Words are runs of anything but ASCII white space; `bytes.split()` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A written table up to this size may be broadcast.
SMALL_TABLE_BYTES = 8 * 1024 * 1024


class WordHashes(dict):
    """Word (bytes) to XXH64.  Emptied at `limit` words, so a worker's memory stays bounded."""

    def __init__(self, limit: int = 500_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 4_000_000) -> Iterator[range]:
    """Runs of texts of about `limit` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield range(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield range(start, len(texts))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every `width` consecutive values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(base)
        out += values[j : j + n]
    return out


def size_of_written(df: DataFrame) -> int:
    """Bytes of the files behind a table that `cut_lineage` wrote, in Catalyst's statistics."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_written(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a written table; broadcast it only if its files are small, else shuffle.

    The plan of a table read from files has their true size, so the check needs no job.
    """
    hinted = F.broadcast(right) if size_of_written(right) <= SMALL_TABLE_BYTES else right
    return left.join(hinted, on, how)


def id_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """52 md5 bits of an id as a long; rows without an id hash their text."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 13), 16, 10).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(*read: str) -> Callable:
    """Decorator of an operator on a frame: columns beside `read` go through under names that meet no other.

    Columns that the operator adds replace input columns of the same name.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **options) -> DataFrame:
            inside = [c if c.lower() in read else f"__input_{i}" for i, c in enumerate(rows.columns)]
            done = operator(rows.toDF(*inside), *args, **options)
            names = dict(zip(inside, rows.columns))
            added = {c.lower() for c in done.columns if c not in names}
            kept = [c for c in done.columns if c not in names or names[c].lower() not in added]
            return done.select(*[F.col(c).alias(names.get(c, c)) for c in kept])

        return run

    return wrap


def arrow_rows(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


__all__ = [
    "SMALL_TABLE_BYTES", "WORD", "WordHashes", "arrow_rows", "chunks", "cut_lineage", "fresh", "id_hash", "join_written",
    "rolling", "shielded", "size_of_written", "utf8",
]
