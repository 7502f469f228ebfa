"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a run of five words are compared: the longest matches that no
earlier match covers are marked again and again (found by running Karp-Rabin hashes), so passages that
were cut up or put in another order are still found.  A document is contaminated by an item whose words
are covered to `coverage` or more.

Seeds meet in a join.  Documents first drop the seeds that no item can have, by a bitmap of the items'
seeds whose size is fixed; a benchmark that fills it makes the join larger, not wrong.  Tiles have at
least five words, so a covered item shares at least a fifth of the covered words as seeds: pairs below
that are dropped without a loss.

Defined cases: words are runs of letters and digits, lower-cased; null, empty and wordless items and
texts match nothing; items with under five words are sought whole; rows that repeat doc_id and text are
one document; rows without doc_id and items without item_id are told apart by their text; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import WordHashes, chunks, cut_lineage, join_written, rolling, shielded, utf8
from trialmill.llm.licenses import ALNUM
from trialmill.llm.substrings import PART_BASE, mix

SEED = 5
COVERAGE = 0.8
FILTER_BITS = 24


def words_of(text: bytes, known: WordHashes) -> np.ndarray:
    return known.of(text.translate(ALNUM).split())


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    return mix(rolling(words, width, PART_BASE))


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of greedy tiles of at least `least` words."""
    least = min(least, len(item))
    if not least:
        return []
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(len(item), 4 * least))
    while True:
        found = _matches(item, text, free_item, free_text, search)
        if found and found[0][0] > 2 * search:
            search = found[0][0]
            continue
        marked = False
        for size, a, b in found:
            if free_item[a : a + size].all() and free_text[b : b + size].all():
                free_item[a : a + size] = free_text[b : b + size] = False
                tiles.append((a, b, size))
                marked = True
        if not marked:
            if search == least:
                return tiles
            search = max(least, search // 2)


def _matches(item, text, free_item, free_text, size: int) -> list[tuple[int, int, int]]:
    """(length, item start, text start) of maximal unmarked matches from `size` words up, longest first."""
    def windows(words, free):
        if len(words) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.concatenate(([0], np.cumsum(~free)))
        ok = np.flatnonzero(marked[size:] == marked[:-size])
        return ok, seeds_of(words, size)[ok]

    at_item, item_hash = windows(item, free_item)
    at_text, text_hash = windows(text, free_text)
    order = np.argsort(item_hash, kind="stable")
    low = np.searchsorted(item_hash[order], text_hash, "left")
    n = np.searchsorted(item_hash[order], text_hash, "right") - low
    b = np.repeat(at_text, n)
    a = at_item[order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    real = np.ones(len(a), bool)
    for j in range(size):  # the words themselves decide
        real &= item[a + j] == text[b + j]
    a, b = a[real], b[real]
    if not len(a):
        return []
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(b - a) != 0) | (np.diff(a) != 1))))
    length = np.diff(np.concatenate((cut, [len(a)]))) + size - 1
    return sorted(zip(length.tolist(), a[cut].tolist(), b[cut].tolist()), key=lambda m: (-m[0], m[1], m[2]))


def _known(items: DataFrame) -> DataFrame:
    """(item_id, ih, text) of every item; the hash of the text tells items without an id apart."""
    return items.select("item_id", F.xxhash64("text").alias("ih"), F.col("text").cast("string").alias("text"))


def item_seeds(items: DataFrame, width: int) -> DataFrame:
    """(item_id, ih, size, width, pos, seed) of every item with words; shorter items are one seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for i, text in enumerate(utf8(batch.column(2))):
                words = words_of(text, known)
                w = min(width, len(words))
                seeds = seeds_of(words, w) if w else np.zeros(0, np.uint64)
                n = len(seeds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * n, pa.int64())), batch.column(1).take(pa.array([i] * n, pa.int64())), pa.array([len(words)] * n, pa.int32()), pa.array([w] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array(seeds.view(np.int64), pa.int64())],
                    names=["item_id", "ih", "size", "width", "pos", "seed"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return _known(items).mapInArrow(
        run, f"item_id {kind}, ih bigint, size int, width int, pos int, seed bigint"
    )


def seed_bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, set where a seed's low bits point; gathered as at most 2^bits / 64 words."""
    slot = F.col("seed").bitwiseAND(F.lit(2**bits - 1))
    one = F.expr("shiftleft(1L, _bit)")
    words = (
        seeds.select(slot.alias("_slot")).select((F.col("_slot") / 64).cast("long").alias("_word"), (F.col("_slot") % 64).cast("int").alias("_bit"))
        .groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    )
    out = np.zeros(2**bits // 64, np.int64)
    table = words.toArrow()
    out[table.column("_word").to_numpy()] = table.column("_bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, width: int = SEED, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, th, item_id, coverage, tiles) of documents that hold `coverage` or more of an item's words.

    th is the hash of the document's text and tells rows with one doc_id apart.
    """
    spark = docs.sparkSession
    seeds = cut_lineage(item_seeds(items, width))
    widths = [r.width for r in seeds.select("width").distinct().collect()]  # at most `width` values
    wanted = spark.sparkContext.broadcast(np.packbits(seed_bitmap(seeds, bits)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bitmap = WordHashes(), np.unpackbits(wanted.value).astype(bool)
        mask = np.uint64(2**bits - 1)
        for batch in batches:
            texts = utf8(batch.column(2))
            for part in chunks(texts):
                row, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i in part:
                    words = words_of(texts[i], known)
                    for w in widths:
                        found = seeds_of(words, w)
                        found = np.unique(found[bitmap[(found & mask).astype(np.int64)]])
                        row.append(np.full(len(found), i))
                        seed.append(found)
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(seed).view(np.int64))],
                    names=["doc_id", "th", "seed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(hits, f"doc_id {kind}, th bigint, seed bigint").distinct()
    enough = F.ceil(F.col("size") * F.lit(coverage) / F.lit(float(width)))
    pairs = cut_lineage(
        found.join(seeds.select("item_id", "ih", "size", "pos", F.col("seed").alias("_seed")), F.col("seed") == F.col("_seed"))
        .groupBy("doc_id", "th", "item_id", "ih", "size").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.least(enough, F.lit(1) + F.greatest(F.col("size") - width, F.lit(0)))).select("doc_id", "th", "item_id", "ih")
    )
    renamed = pairs.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "item_id", "ih")
    both = join_written(texts, renamed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    named = cut_lineage(_known(items).select(F.col("item_id").alias("_item"), F.col("ih").alias("_ih"), F.col("text").alias("item_text")))
    compared = join_written(both, named, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("ih") == F.col("_ih"))).select("doc_id", "th", "item_id", "text", "item_text")
    item_kind = items.schema["item_id"].dataType.simpleString()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            share, n, last, words = [], [], None, None
            for text, item in zip(utf8(batch.column(3)), utf8(batch.column(4))):
                if text != last:
                    last, words = text, words_of(text, known)
                sought = words_of(item, known)
                tiles = tile(sought, words, width)
                share.append(sum(t[2] for t in tiles) / max(1, len(sought)))
                n.append(len(tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(share, pa.float64()), pa.array(n, pa.int64())],
                names=["doc_id", "th", "item_id", "coverage", "tiles"],
            )

    measured = compared.mapInArrow(cover, f"doc_id {kind}, th bigint, item_id {item_kind}, coverage double, tiles bigint")
    return measured.where(F.col("coverage") >= coverage).distinct()


@shielded("doc_id", "text")
def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the contaminated ones."""
    found = contaminated(docs, items, **options).select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).distinct()
    found = cut_lineage(found)
    return join_written(docs, found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_th")), "left_anti")
