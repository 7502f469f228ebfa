"""Near-duplicates by HyperMinHash: compressed minima, bands, corrected similarity, whole sets.

The hashes of a set fall into buckets by their upper bits.  A bucket's register holds the number of leading
zeros of its least value and the `MANTISSA` bits after the first one: 16 bits in place of 64.  Empty buckets
take the register of the first full one in an order of their own, so that small sets have no empty bands and
two sets agree in a register with the probability of their similarity J.  `rows` registers are a band's key:
a pair shares a key with probability 1 - (1 - J^rows)^bands.

Candidates go through three sieves, each before more of a set travels: sizes, which bound J; the share
of equal registers, corrected for registers that agree by chance; the whole sets of 64-bit hashes.  The second
leaves six standard deviations of room, so that it passes over an alike pair once in about 10^9.

Sets that are equal fold into one point, and classes of points come from `pairs.classes`: no link between
different sets is lost to a cap, and copies never make pairs.

Defined cases: rows without words (null and empty texts too) have the empty set, are classes of their own and
stay; fewer words than a shingle are one shingle; a class without any doc_id has a null component_id and its
rows stay; rows that repeat an id share its class and stay; columns beside doc_id and text are not read; an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import cut_lineage, join_written, utf8
from trialmill.llm.pairs import TILE, classes
from trialmill.llm.simhash import LOWER
from trialmill.session import forget

SHINGLE = 3
LEAST = (85, 100)
BANDS, ROWS = 30, 6
MANTISSA = 10
SEED = 42
DEVIATIONS = 6.0


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of `width` lower-cased words; none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist())), np.uint64, n
    ))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Values that tell nothing of the bits that chose the bucket."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


@lru_cache(maxsize=4)
def _detours(buckets: int) -> np.ndarray:
    """For each bucket the order in which it looks for a full one."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(buckets) for _ in range(buckets)])


def registers(hashes: np.ndarray, buckets: int = BANDS * ROWS) -> np.ndarray:
    """The registers of a non-empty set of sorted distinct hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint16)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
    least = np.minimum.reduceat(_mixed(hashes), starts)
    zeros = np.uint64(64) - np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(63))
    mantissa = ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(buckets, np.uint16)
    full = np.zeros(buckets, bool)
    at = bucket[starts].astype(np.int64)
    out[at], full[at] = (zeros << np.uint64(MANTISSA)) | mantissa, True
    empty = np.flatnonzero(~full)
    if len(empty):
        way = _detours(buckets)[empty]
        out[empty] = out[way[np.arange(len(empty)), full[way].argmax(axis=1)]]
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band, of the band's number and its registers."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(values.reshape(-1, rows))], np.uint64).view(np.int64)


def spread(n: np.ndarray, buckets: int) -> np.ndarray:
    """For sets of n hashes the probabilities of a register's numbers of leading zeros, a row each."""
    edges = 0.5 ** np.arange(0, 41)
    below = -np.expm1(n.astype(float)[:, None] * np.log1p(-edges[None, :] / buckets))  # a minimum under each power of two
    return -np.diff(below / below[:, :1], axis=1)


def chance_matches(spread_a: np.ndarray, spread_b: np.ndarray) -> np.ndarray:
    """Probability that registers of unlike minima agree: in the zeros, and in all bits of the mantissa."""
    return (spread_a * spread_b).sum(axis=1) / 2**MANTISSA


def corrected(a: np.ndarray, b: np.ndarray, spread_a: np.ndarray, spread_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of register rows, corrected for chance matches."""
    chance = chance_matches(spread_a, spread_b)
    return np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1.0 - chance))


def needed(n_a: np.ndarray, n_b: np.ndarray, buckets: int, least: float) -> np.ndarray:
    """The estimate that still leaves room for a similarity of `least`; small sets have fewer free registers."""
    free = np.minimum(np.minimum(n_a, n_b), buckets) / 2.0
    return least - DEVIATIONS * np.sqrt(least * (1 - least) / free)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def sketches(docs: DataFrame, width: int, bands: int, rows: int, more_keys=None) -> DataFrame:
    """(doc_id, th, point, n, registers, keys) of every row; point is the hash of the set, th that of the text.

    `more_keys` gives further keys of a set of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes, held, keys = [], [], [], []
            for text in utf8(batch.column(2)):
                found = shingles(text, width)
                values = registers(found, bands * rows)
                points.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                held.append(values.tobytes())
                own = band_keys(values, rows)
                keys.append(np.concatenate((own, more_keys(found))) if more_keys and len(found) else own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(points, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(held, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "th", "point", "n", "registers", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, th bigint, point bigint, n bigint, registers binary, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, buckets: int) -> DataFrame:
    """(point, held, hashes) of the wanted rows (_doc, _th, point); held are the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width) for t in utf8(batch.column(1))]
            held = [registers(x, buckets).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["point", "held", "hashes"]
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    texts = join_written(rows, wanted, same).select("point", "text")
    return texts.mapInArrow(run, "point bigint, held binary, hashes binary").dropDuplicates(["point"])


def tile_links(labels: np.ndarray, blocks: np.ndarray, held: np.ndarray, sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning links between the classes of a tile's points; points of two blocks are compared across them only."""
    sizes = np.array([len(x) for x in sets])
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids, minlength=len(words)))
    starts = np.concatenate(([0], ends[:-1]))
    first = np.concatenate(([0], np.cumsum(sizes)))
    values, own = np.unique(labels, return_inverse=True)
    across = blocks.min() != blocks.max()
    odds = spread(sizes, held.shape[1])
    out = []
    # pairs inside the largest class need no look, and every other pair has a point outside of it
    for i in np.flatnonzero(own != np.bincount(own).argmax()):
        others = own != own[i]
        if across:
            others &= blocks != blocks[i]
        others &= least[1] * np.minimum(sizes, sizes[i]) >= least[0] * np.maximum(sizes, sizes[i])
        at = np.flatnonzero(others)
        at = at[corrected(held[at], held[i], odds[at], odds[i]) >= needed(sizes[at], sizes[i], held.shape[1], least[0] / least[1])]
        if not len(at):
            continue
        mine = ids[first[i] : first[i + 1]]
        runs = ends[mine] - starts[mine]
        places = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        both = np.bincount(owner[places], minlength=len(sets))[at]
        for j in at[least[1] * both >= least[0] * (sizes[i] + sizes[at] - both)]:
            if own[i] != own[j]:
                out.append((int(labels[i]), int(labels[j])))
                own[own == own[j]] = own[i]
    return out


def _tiled(rows: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(la, lb) links of tiles, which come as sorted runs."""

    def links(run):
        columns = list(zip(*run))
        held = np.stack([np.frombuffer(x, np.uint16) for x in columns[2]])
        found = tile_links(np.array(columns[1]), np.array(columns[0]), held, [np.frombuffer(x, np.uint64) for x in columns[3]], least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["la", "lb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered = None, []
        for batch in batches:
            tile = zip(*[batch.column(c).to_pylist() for c in ("key", "one", "two")])
            rest = zip(*[batch.column(c).to_pylist() for c in ("block", "label")], *[batch.column(c).cast(pa.binary()).to_pylist() for c in ("held", "hashes")])
            for place, row in zip(tile, rest):
                if place != at:
                    if gathered:
                        yield links(gathered)
                    at, gathered = place, []
                gathered.append(row)
        if gathered:
            yield links(gathered)

    joined = rows.join(sets.withColumnRenamed("point", "_point"), F.col("point") == F.col("_point"))
    order = ["key", "one", "two"]
    ordered = joined.select(*order, "block", "label", "held", "hashes").repartition(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "la bigint, lb bigint")


def _sieve(pairs: DataFrame, points: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, la, b, lb) whose sizes and registers leave room for the similarity."""
    kind = "a bigint, la bigint, b bigint, lb bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(c).cast(pa.binary()).to_pylist()]) for c in ("ra", "rb"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("na", "nb"))
            size = left.shape[1]
            near = corrected(left, right, spread(n_a, size), spread(n_b, size)) >= needed(n_a, n_b, size, least[0] / least[1])
            yield batch.select(["a", "la", "b", "lb"]).filter(pa.array(near))

    first = points.select(F.col("point").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    second = points.select(F.col("point").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    sized = pairs.join(first, "a").join(second, "b").where(least[1] * F.least("na", "nb") >= least[0] * F.greatest("na", "nb"))
    return sized.select("a", "la", "b", "lb", "na", "nb", "ra", "rb").mapInArrow(run, kind)


def _alike(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, la, b, lb) whose whole sets are alike: least[1] * intersection >= least[0] * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("ha", "hb"))
            near = []
            for a, b in zip(left, right):
                both = intersection(a, b)
                near.append(least[1] * both >= least[0] * (len(a) + len(b) - both))
            yield batch.select(["a", "la", "b", "lb"]).filter(pa.array(near, pa.bool_()))

    first = sets.select(F.col("point").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("point").alias("b"), F.col("hashes").alias("hb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "la", "b", "lb", "ha", "hb")
    return joined.mapInArrow(run, "a bigint, la bigint, b bigint, lb bigint")


def point_classes(docs: DataFrame, found: DataFrame, width: int, least: tuple[int, int], buckets: int, tile: int = TILE) -> DataFrame:
    """(node, root) of the points of `found` (written `sketches` of `docs`) that are alike to another."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")
    columns = [F.first(c).alias(c) for c in ("n", "registers", "keys")]
    points = cut_lineage(found.where("n > 0").groupBy("point").agg(best, *columns))
    rows = points.select("point", F.explode("keys").alias("key"))
    read: list[DataFrame] = []

    def sets_of(named: DataFrame) -> DataFrame:
        """Sets of the named points, read from their texts unless an earlier round did."""
        for sets in read:
            named = named.join(sets.select("point"), "point", "left_anti")
        wanted = cut_lineage(points.join(named, "point").select(F.col("best.doc_id").alias("_doc"), F.col("best.th").alias("_th"), "point"))
        read.append(cut_lineage(_sets(docs, wanted, width, buckets)))
        forget(wanted)
        every = read[0]
        for sets in read[1:]:
            every = every.unionByName(sets)
        return every

    def alike(pairs: DataFrame) -> DataFrame:
        near = cut_lineage(_sieve(pairs, points, least))
        named = near.select(F.col("a").alias("point")).unionByName(near.select(F.col("b").alias("point"))).distinct()
        return _alike(near, sets_of(named), least)

    def finish(tiled: DataFrame) -> DataFrame:
        return _tiled(tiled, sets_of(tiled.select("point").distinct()), least)

    roots = classes(rows, alike, finish, tile=tile)
    forget(points, *read)
    return roots


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, least: tuple[int, int] = LEAST, bands: int = BANDS, rows: int = ROWS, tile: int = TILE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows link where least[1] * intersection >= least[0] * union of their shingle sets; component_id is the
    smallest doc_id reachable, the row's own included.
    """
    found = cut_lineage(sketches(docs, width, bands, rows))
    roots = point_classes(docs, found, width, least, bands * rows, tile)
    slim = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("point")).alias("point"))
    rooted = slim.join(roots, F.col("point") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "point").alias("root"))
    rooted = cut_lineage(rooted)
    forget(found, roots)
    least_ids = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("_least")).withColumnRenamed("root", "_root")
    joined = rooted.join(least_ids, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
