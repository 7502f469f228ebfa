"""Substring deduplication: Rabin-Karp hashes of every token window, matched in Spark.

Every window of `window` words gets a rolling hash.  Windows that share the smallest hash of their
`window`/2-word parts at the same place sit in one row with that part's hash as key, about six to a
row, so the shuffle moves bytes and not a row per window; equal windows always meet, since the part
is a function of the window's words.  A match takes 64 bits of the part and 32 of the window.

Repeats inside one chunk of documents are settled before the shuffle, so a passage that a third of
all documents share arrives once a chunk.  After the shuffle each key is read as a sorted stream; the
first window in document order stays and later ones become intervals.  A key with more than `GROUP`
windows is handed on window by window to a second shuffle, so no key is held in memory whole.
Intervals of a document merge to maximal runs, which are cut out of its whole text.

Defined cases: null and empty texts have no words and lose none; texts shorter than a window lose
none; rows that repeat doc_id and text count as one document and get one result; rows without doc_id
come after all others; different texts under one doc_id are ordered by their hash; an empty table
stays empty; added columns replace ones of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trialmill.llm.common import WordHashes, chunks, rolling, utf8

WINDOW = 20
#: Odd multipliers of the two rolling hashes.
PART_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
GROUP = 200_000
CHUNK_BYTES = 4_000_000

#: marks: 4 bytes a window of the row; none: the windows from `start` on are settled as repeats.
ROWS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("th", T.LongType()),
    T.StructField("start", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("marks", T.BinaryType()),
])
ARROW = pa.schema([
    ("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("first", pa.int32()),
    ("n", pa.int32()), ("marks", pa.binary()),
])


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher: spreads every bit of a product hash over all 64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows_of(words: np.ndarray, lengths: np.ndarray, window: int):
    """Of all whole windows of documents laid end to end: document, start, hash, place and hash of the least part."""
    part = max(1, window // 2)
    room = window - part + 1
    hashes = mix(rolling(words, window, WINDOW_BASE))
    parts = mix(rolling(words, part, PART_BASE))
    n = len(hashes)
    least, place = parts[:n].copy(), np.zeros(n, np.int32)
    for j in range(1, room):
        other = parts[j : j + n]
        smaller = other < least
        place[smaller] = j
        np.minimum(least, other, out=least)
    begin = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)[:n]
    start = np.arange(n) - begin[doc]
    whole = start + window <= lengths[doc]
    return doc[whole], start[whole], hashes[whole], place[whole], least[whole]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of 4-byte values as an Arrow binary column."""
    offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.astype("<u4").tobytes())])


def _settled(doc, th, start, n) -> pa.RecordBatch:
    """Intervals of starts that are known as repeats; the key only spreads them."""
    key = mix(th.astype(np.int64).view(np.uint64) + start.astype(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), doc, pa.array(th.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(np.zeros(len(th), np.int32)),
         pa.array(n.astype(np.int32)), pa.nulls(len(th), pa.binary())], schema=ARROW,
    )


def _emit_windows(window: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = utf8(batch.column(2))
            for part in chunks(texts, chunk):
                rows = batch.slice(part.start, len(part))
                yield from _chunk_rows(rows.column(0), rows.column(1).to_numpy(), texts[part.start : part.stop], window, known)

    return run


def _chunk_rows(ids: pa.Array, th: np.ndarray, texts: list[bytes], window: int, known: WordHashes) -> Iterator[pa.RecordBatch]:
    # documents in the order that decides what is earlier; equal rows once
    none = np.asarray(ids.is_null())
    order = np.lexsort((th, ids.fill_null(0).to_numpy(), none))
    keep, last = [], None
    for i in order.tolist():
        here = (ids[i].as_py(), th[i], texts[i])
        if here != last:
            keep.append(i)
        last = here
    taken = pa.array(keep, pa.int64())
    ids, th = ids.take(taken), th[keep]
    words = [known.of(texts[i].split()) for i in keep]
    lengths = np.array([len(w) for w in words], np.int64)
    doc, start, hashes, place, least = windows_of(np.concatenate([*words, np.zeros(0, np.uint64)]), lengths, window)
    if not len(doc):
        return
    by_hash = np.argsort(hashes, kind="stable")
    again = np.zeros(len(doc), bool)
    again[by_hash[1:]] = (hashes[by_hash[1:]] == hashes[by_hash[:-1]]) & (least[by_hash[1:]] == least[by_hash[:-1]])
    at = runs(doc, start + place)  # windows of one part stand side by side
    n = np.diff(np.concatenate((at, [len(doc)])))
    done = np.logical_and.reduceat(again, at)
    send = ~done
    if send.any():
        marks = hashes[np.repeat(send, n)] >> np.uint64(32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[at[send]].view(np.int64)), ids.take(pa.array(doc[at[send]])), pa.array(th[doc[at[send]]].astype(np.int64)),
             pa.array(start[at[send]].astype(np.int32)), pa.array(place[at[send]].astype(np.int32)), pa.array(n[send].astype(np.int32)),
             _binary(marks, np.cumsum(n[send]))], schema=ARROW,
        )
    flagged = np.flatnonzero(np.repeat(done, n))
    if len(flagged):
        cut = runs(doc[flagged], start[flagged] - np.arange(len(flagged)))
        size = np.diff(np.concatenate((cut, [len(flagged)])))
        d = doc[flagged[cut]]
        yield _settled(ids.take(pa.array(d)), th[d], start[flagged[cut]], size)


def _same_place(ids: pa.Array, th: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j are of one document."""
    none, values = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
    return (none[i] == none[j]) & (values[i] == values[j]) & (th[i] == th[j])


def _match(group: int):
    """Rows sorted by key, document, start: intervals of repeated windows, and the windows of outsized keys."""

    def solve(table: pa.Table, handed: bool) -> Iterator[pa.RecordBatch]:
        settled = np.asarray(table.column("marks").is_null())
        if settled.any():
            yield from table.filter(pa.array(settled)).combine_chunks().to_batches()
            table = table.filter(pa.array(~settled))
        if not len(table):
            return
        table = table.combine_chunks()
        key, ids, th, start, first, n, marks = (table.column(f.name).combine_chunks() for f in ARROW)
        key, th, start, first, n = (x.to_numpy() for x in (key, th, start, first, n))
        offsets = np.frombuffer(marks.buffers()[1], np.int32, len(marks) + 1, marks.offset * 4)
        values = np.frombuffer(marks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
        if not handed:  # only keys that stand in several rows can repeat
            edge = runs(key)
            many = np.repeat(np.diff(np.concatenate((edge, [len(key)]))) > 1, np.diff(np.concatenate((edge, [len(key)]))))
            values, (key, th, start, first, n) = values[np.repeat(many, n)], (x[many] for x in (key, th, start, first, n))
            ids = ids.filter(pa.array(many))
            if not len(key):
                return
        row = np.repeat(np.arange(len(key)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        offset, begin = first[row] - step, start[row] + step
        if handed:
            mixed = mix(key[row].view(np.uint64) ^ (values.astype(np.uint64) << np.uint64(8)) ^ offset.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mixed), ids.take(pa.array(row)), pa.array(th[row]), pa.array(begin.astype(np.int32)),
                 pa.array(offset.astype(np.int32)), pa.array(np.ones(len(row), np.int32)), _binary(values, np.arange(1, len(row) + 1))], schema=ARROW,
            )
            return
        order = np.lexsort((values, offset, key[row]))  # stable: document order inside equal windows
        k, o, v = key[row][order], offset[order], values[order]
        edge = runs(k, o, v)
        head = order[np.repeat(edge, np.diff(np.concatenate((edge, [len(order)]))))]
        same = _same_place(ids, th, row[order], row[head]) & (begin[order] == begin[head])
        later = np.sort(order[~same])
        if len(later):
            cut = runs(row[later], begin[later] - np.arange(len(later)))
            size = np.diff(np.concatenate((cut, [len(later)])))
            r = row[later[cut]]
            yield _settled(ids.take(pa.array(r)), th[r], begin[later[cut]], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = pa.Table.from_batches([], ARROW), None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch], ARROW)])
            keys = held.column("key").to_numpy()
            if hot is not None:  # what follows of a key that was handed on goes the same way
                stop = int(np.searchsorted(keys, hot, side="right"))
                yield from solve(held.slice(0, stop), True)
                held, keys = held.slice(stop), keys[stop:]
                if not len(keys):
                    continue
                hot = None
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from solve(held.slice(0, cut), False)
            held = held.slice(cut)
            if len(held) and sum(held.column("n").to_pylist()) > group:
                hot = int(keys[-1])
                yield from solve(held, True)
                held = held.slice(len(held))
        yield from solve(held, False)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, group: int = GROUP, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(doc, th, start, n): runs of window starts whose words also start earlier; th is the text's hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_emit_windows(window, chunk), ROWS)
    order = ["key", F.col("doc").asc_nulls_last(), "th", "start"]
    met = rows.repartition("key").sortWithinPartitions(*order).mapInArrow(_match(group), ROWS)
    # outsized keys once more, window by window; settled rows pass
    met = met.repartition("key").sortWithinPartitions(*order).mapInArrow(_streamed(), "doc bigint, th bigint, start int, n int")
    return met


def _streamed():
    """Rows sorted by key, document, start; a row is a window or a settled interval.  Only the last row is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            settled = np.asarray(batch.column("marks").is_null())
            yield batch.filter(pa.array(settled)).select(["doc", "th", "start", "n"])
            rest = batch.filter(pa.array(~settled))
            if not rest.num_rows:
                continue
            seen = pa.Table.from_batches(([tail] if tail is not None else []) + [rest]).combine_chunks().to_batches()[0]
            key, th, start = (seen.column(c).to_numpy() for c in ("key", "th", "start"))
            ids = seen.column("doc")
            edge = runs(key)
            head = np.repeat(edge, np.diff(np.concatenate((edge, [len(key)]))))
            later = ~(_same_place(ids, th, np.arange(len(key)), head) & (start == start[head]))
            if tail is not None:
                later[0] = False
            yield seen.filter(pa.array(later)).select(["doc", "th", "start", "n"])
            tail = seen.slice(int(edge[-1]), 1)  # the first of the last key

    return run


def cut_words(words: list[bytes], starts: list[int], sizes: list[int], window: int) -> list[bytes]:
    """What is left when the windows that start in the given runs are cut out."""
    level = np.zeros(len(words) + 1, np.int64)
    for start, size in zip(starts, sizes):
        level[start] += 1
        level[min(len(words), start + size - 1 + window)] -= 1
    gone = np.cumsum(level[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words


def removal_runs(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """`docs` with `_runs`: the repeated window starts of each row as an array of (start, n), or null."""
    found = repeated_windows(docs, window, **options).groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("start", "n")).alias("_runs")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_th"))
    return docs.drop("_runs", "_doc", "_th").join(found, same, "left").drop("_doc", "_th")


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept is the text that is left, if `texts`."""
    marked = removal_runs(docs.select("doc_id", "text"), window, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, found = utf8(batch.column("text")), batch.column("_runs").to_pylist()
            for part in chunks(whole):
                size, gone, digest, left = [], [], [], []
                for text, spans in zip(whole[part.start : part.stop], found[part.start : part.stop]):
                    words = text.split()
                    kept = cut_words(words, [s["start"] for s in spans or ()], [s["n"] for s in spans or ()], window)
                    joined = b" ".join(kept)
                    size.append(len(words))
                    gone.append(len(words) - len(kept))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    left.append(joined if texts else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(part)), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(digest), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return marked.select("doc_id", F.col("text").cast("string").alias("text"), "_runs").mapInArrow(run, out)
