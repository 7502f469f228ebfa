"""Points of a class packed into blocks of doubles, and K-Means on them in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, small_side

BLOCK_BYTES = 256 * 1024
#: Bytes of vectors up to which one task holds a class and runs all its restarts; larger classes move in common rounds.
WHOLE_BYTES = 256 * 1024 * 1024

#: Squared shifts below this share of a centroid's squared length are rounding.
ROUNDING = 1e-24


#: A block's columns beside its label.
PARTS = ("x", "h", "lacks")


class Block(NamedTuple):
    """Vectors with 0 for what is no number; where they have one (None: everywhere); hashes of the points; which have no distance."""

    x: np.ndarray
    known: np.ndarray | None
    h: np.ndarray
    lacks: np.ndarray | None


def block_rows(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * dim))


def class_sizes(points: DataFrame, label: str, dim: int, whole_bytes: int) -> DataFrame:
    """(label, blocks, whole): into how many blocks a class goes, and whether one task may hold it."""
    counted = points.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("_n"))
    return cut_lineage(counted.select(
        "label", F.ceil(F.col("_n") / block_rows(dim)).cast("int").alias("blocks"),
        (F.col("_n") * 8 * dim <= whole_bytes).alias("whole")))


def pack(points: DataFrame, sizes: DataFrame, label: str, point: str, vec: str, dim: int) -> DataFrame:
    """(label, whole, x, h, lacks): blocks of vectors and of their points' hashes, sorted by label within a file.

    Numbers that are missing are NaN; a vector with such numbers or of another length lacks a distance.  One shuffle of the points.
    """
    keyed = points.select(F.col(label).alias("label"), F.xxhash64(F.col(point)).alias("h"), F.col(vec).alias("v"))
    dealt = keyed.join(small_side(sizes), "label").withColumn("block", F.pmod("h", "blocks").cast("int"))
    ordered = dealt.repartition("label", "block").sortWithinPartitions("label", "block", "h").select("label", "block", "whole", "h", "v")
    kind = ordered.schema["label"].dataType.simpleString()
    most = 4 * block_rows(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def block() -> pa.RecordBatch:
            x, *rest = (np.concatenate(part) for part in zip(*held))
            parts = [pa.array([part.tobytes()], pa.binary()) for part in (shortened(x), *rest)]
            return pa.RecordBatch.from_arrays([key[0], key[2], *parts], ["label", "whole", "x", "h", "lacks"])

        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, lacks = doubles(batch["v"], dim)
            at, hashes = batch["block"].to_numpy(), batch["h"].to_numpy()
            codes = batch["label"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(at) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(at)]):
                now = (batch["label"].slice(start, 1), int(at[start]), batch["whole"].slice(start, 1))
                if held and (now[1] != key[1] or now[0] != key[0] or n >= most):
                    yield block()
                    held, n = [], 0
                key = now
                held.append((vectors[start:end], hashes[start:end], lacks[start:end]))
                n += end - start
        if held:
            yield block()

    return cut_lineage(ordered.mapInArrow(run, f"label {kind}, whole boolean, x binary, h binary, lacks binary"))


def shortened(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers if none changes by that."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if np.array_equal(short, x, equal_nan=True) else x


def doubles(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of `dim` doubles, NaN where one is missing; and which have no distance to a centroid."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == dim).all():
        out = flat.reshape(-1, dim)
    else:
        out = np.full((len(vectors), dim), np.nan)
        for row, start, n in zip(out, np.cumsum(lengths) - lengths, lengths):
            row[:min(n, dim)] = flat[start:start + min(n, dim)]
    return out, (lengths != dim) | ~np.isfinite(out).all(axis=1)


def opened(x: pa.Scalar, h: pa.Scalar, lacks: pa.Scalar, dim: int) -> Block:
    hashes, lacking = np.frombuffer(h.as_buffer(), "<i8"), np.frombuffer(lacks.as_buffer(), bool)
    kind = "<f4" if x.as_buffer().size == 4 * dim * len(hashes) else "<f8"
    vectors = np.frombuffer(x.as_buffer(), kind).reshape(-1, dim)
    if not lacking.any():
        return Block(vectors, None, hashes, None)
    known = np.isfinite(vectors)
    return Block(np.where(known, vectors, 0.0), known, hashes, lacking)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances summed number by number, as `vectors.squared_distance` does."""
    total = np.zeros((len(x), *c.shape[:2]))
    for j in range(x.shape[1]):
        gap = x[:, j, None, None] - c[None, :, :, j]
        total += gap * gap
    return np.where(np.isnan(total), np.inf, total)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of every run, its squared distance and that of the second, (points, runs) each, and their rounding by point.

    `c` is (runs, clusters, dim), NaN where a run has fewer clusters.  A tie goes to the lower cluster.  Distances come
    from one product of matrices; where its rounding could change the choice, they are summed number by number.
    """
    x = np.asarray(x, float)
    runs, k, dim = c.shape
    flat = c.reshape(-1, dim)
    there = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = x.mean(axis=0) if len(x) else 0.0
        near, at = x - middle, np.where(there[:, None], flat - middle, 0.0)
        size, reach = (near * near).sum(axis=1), (at * at).sum(axis=1)
        gap = near @ (-2.0 * at.T)
        gap += size[:, None]
        gap += reach
        gap[:, ~there] = np.inf
        gap = gap.reshape(-1, runs, k)

        def two(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = gap.argmin(axis=2)
            least = np.take_along_axis(gap, own[..., None], axis=2)[..., 0]
            np.put_along_axis(gap, own[..., None], np.inf, axis=2)
            return own, least, gap.min(axis=2)

        own, least, second = two(gap)
        slack = 8 * (dim + 8) * np.finfo(float).eps * (size + reach.max())
        unsure = ~(second > least + slack[:, None]).all(axis=1) | ~np.isfinite(least).all(axis=1)
        if unsure.any():
            own[unsure], least[unsure], second[unsure] = two(_exact(x[unsure], c))
    return own, np.maximum(least, 0.0), np.maximum(second, 0.0), slack


def placed(block: Block, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids and squared distances; a vector without a distance stands in the lowest cluster."""
    own, d2 = nearest(block.x, c)[:2]
    if block.lacks is not None:
        own[block.lacks], d2[block.lacks] = 0, 0.0
    return own, d2


def totals(blocks: list[Block], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run and cluster: sums and counts of each number, points; per run: inertia."""
    runs, k, dim = c.shape
    sums, seen, n, inertia = np.zeros(c.shape), np.zeros(c.shape), np.zeros((runs, k)), np.zeros(runs)
    for block in blocks:
        x, known = np.asarray(block.x, float), block.known
        own, d2 = placed(block, c)
        member = np.zeros((len(x), runs * k))
        member[np.arange(len(x))[:, None], own + k * np.arange(runs)] = 1.0
        here = member.sum(axis=0).reshape(runs, k)
        sums += (member.T @ x).reshape(c.shape)
        seen += here[..., None] if known is None else (member.T @ known).reshape(c.shape)
        n += here
        inertia += d2.sum(axis=0)
    return sums, seen, n, inertia


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(h: np.ndarray, value: int) -> np.ndarray:
    """Spark's xxhash64 of one more integer column behind the hash `h`."""
    with np.errstate(over="ignore"):
        out = h.astype(np.uint64) + _P[3] + np.uint64(4)
        out ^= np.uint64(value) * _P[0]
        out = ((out << np.uint64(23)) | (out >> np.uint64(41))) * _P[1] + _P[2]
        out ^= out >> np.uint64(33)
        out *= _P[1]
        out ^= out >> np.uint64(29)
        out *= _P[2]
        return out ^ (out >> np.uint64(32))


def race(h: np.ndarray, restart: int, step: int, weight: np.ndarray) -> np.ndarray:
    """Exponential race: the smallest key is a draw with probability proportional to `weight`; none at weight 0."""
    mixed = _mixed(_mixed(h, restart), step) & np.uint64((1 << 52) - 1)
    uniform = (mixed.astype(float) + 0.5) / float(1 << 52)
    with np.errstate(divide="ignore"):
        return -np.log(uniform) / weight


def drawn(block: Block, c: Sequence[np.ndarray], step: int) -> Iterator[tuple[int, float, int, np.ndarray]]:
    """(restart, key, hash, vector) of the block's winners of one step of k-means++; `c`: centroids so far of each restart.

    A vector without a distance can only win the first step, and only if its class has no other.
    """
    x = np.asarray(block.x, float)
    for restart, before in enumerate(c):
        weight = np.full(len(x), np.inf if len(before) else 1.0)
        for centroid in before:
            gap = x - centroid
            np.minimum(weight, (gap * gap).sum(axis=1), out=weight)
        if block.lacks is not None:
            weight[block.lacks] = 0.0 if step else 1e-300
        key = race(block.h, restart, step, weight)
        at = np.lexsort((block.h, key))[0] if len(key) else 0
        if len(key) and np.isfinite(key[at]):
            yield restart, float(key[at]), int(block.h[at]), x[at]


def padded(c: Sequence[np.ndarray], dim: int) -> np.ndarray:
    """(runs, clusters, dim), NaN where a run has fewer clusters than others."""
    out = np.full((len(c), max(map(len, c)), dim), np.nan)
    for one, part in zip(out, c):
        one[:len(part)] = part
    return out


def _seeds(blocks: list[Block], k: int, restarts: int) -> np.ndarray:
    """Distance-weighted seeding (k-means++); a class with fewer distinct vectors than `k` gets fewer centroids."""
    dim = blocks[0].x.shape[1]
    c = [np.empty((0, dim))] * restarts
    for step in range(k):
        best: dict[int, tuple] = {}
        for block in blocks:
            for restart, *found in drawn(block, c, step):
                best[restart] = min(best.get(restart, found), found, key=lambda f: f[:2])
        c = [np.vstack([before, best[r][2]]) if r in best else before for r, before in enumerate(c)]
    return padded(c, dim)


def joined(blocks: list[Block]) -> Block:
    """All blocks as one."""
    x, h = (np.concatenate([getattr(b, name) for b in blocks]) for name in ("x", "h"))
    if all(b.lacks is None for b in blocks):
        return Block(x, None, h, None)
    return Block(x, np.concatenate([np.ones(b.x.shape, bool) if b.known is None else b.known for b in blocks]), h,
                 np.concatenate([np.zeros(len(b.h), bool) if b.lacks is None else b.lacks for b in blocks]))


def parted(block: Block, rows: int) -> list[Block]:
    """Views of so many rows each."""
    return [Block(*(None if part is None else part[i:i + rows] for part in block)) for i in range(0, len(block.h), rows)]


def progress(inertia: float, least: float, stale: int, rounds: int) -> tuple[float, int]:
    """Least inertia so far and the rounds since; Lloyd's rounds end by themselves as long as it falls."""
    if inertia < least:
        return inertia, 0
    if stale >= rounds:
        raise RuntimeError(f"clusters still move after {rounds} rounds without a lower inertia")
    return least, stale + 1


class _Run:
    """One run of Lloyd's rounds over all points of a class.

    A point keeps an upper bound of the distance to its centroid and a lower bound of that to any other one; rounds widen
    them by the centroids' moves, and only points whose bounds meet are measured anew (Hamerly).  Sums change
    by the points that changed their cluster.  Nothing ends before a round over all points has confirmed it.
    """

    def __init__(self, points: Block, c: np.ndarray):
        self.points, self.c = points, c[np.isfinite(c).all(axis=1)]
        n = len(points.h)
        self.own, self.up, self.low = np.zeros(n, np.intp), np.zeros(n), np.full(n, np.inf)
        self.usual = np.arange(n) if points.lacks is None else np.flatnonzero(~points.lacks)

    def measure(self, at: np.ndarray) -> None:
        """Cluster and bounds of the points `at`."""
        own, least, second, slack = (a.reshape(len(at)) for a in nearest(self.points.x[at], self.c[None]))
        self.own[at] = own
        self.up[at], self.low[at] = np.sqrt(least + slack), np.sqrt(np.maximum(second - slack, 0.0))

    def added(self, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums, counts of numbers, and points by cluster, over the points `at`."""
        member = np.zeros((len(at), len(self.c)))
        member[np.arange(len(at)), own] = 1.0
        n = member.sum(axis=0)
        sums = member.T @ np.asarray(self.points.x[at], float)
        seen = np.broadcast_to(n[:, None], sums.shape) if self.points.known is None else member.T @ self.points.known[at]
        return sums, seen, n

    def over(self, at: np.ndarray, rows: int = 2048):
        return (at[i:i + rows] for i in range(0, len(at), rows))

    def all_anew(self) -> None:
        for at in self.over(self.usual):
            self.measure(at)
        parts = [self.added(at, self.own[at]) for at in self.over(np.arange(len(self.own)))]
        self.sums, self.seen, self.n = (sum(part) for part in zip(*parts))

    def where_bounds_meet(self) -> None:
        for at in self.over(np.flatnonzero(self.up * (1 + 1e-9) >= self.low)):
            before = self.own[at]
            self.measure(at)
            changed = before != self.own[at]
            if changed.any():
                went, came = self.added(at[changed], before[changed]), self.added(at[changed], self.own[at[changed]])
                self.sums, self.seen, self.n = (
                    total - a + b for total, a, b in zip((self.sums, self.seen, self.n), went, came))

    def inertia(self) -> float:
        return sum(float(placed(part, self.c[None])[1].sum()) for part in parted(self.points, 2048))

    def farthest(self) -> np.ndarray:
        d2 = np.concatenate([placed(part, self.c[None])[1][:, 0] for part in parted(self.points, 2048)])
        return np.asarray(self.points.x[np.lexsort((self.points.h, d2))[-1]], float)

    def settle(self, rounds: int, tolerance: float) -> np.ndarray:
        whole, turn, least = True, 0, np.inf
        while True:
            if turn == rounds:
                least, _ = progress(self.inertia(), least, rounds, rounds)
                whole, turn = True, 0
            if whole:
                self.all_anew()
            else:
                self.where_bounds_meet()
            before = self.c
            after = np.where(self.seen > 0.5, self.sums / np.maximum(self.seen, 1.0), before)
            lost = np.flatnonzero(self.n < 0.5)
            if lost.size:
                after[lost[0]] = self.farthest()
            step = np.sqrt(((after - before) ** 2).sum(axis=1))
            moves = lost.size > 0 or step.max() ** 2 > max(tolerance ** 2, ROUNDING * (after * after).sum(axis=1).max())
            self.c, turn = after, turn + 1
            if whole and not moves:
                return after
            whole = not moves
            self.up += step[self.own]
            self.low -= step.max()


def whole_class(blocks: list[Block], k: int, restarts: int, rounds: int, tolerance: float) -> np.ndarray:
    """Centroids of the best of all restarts of one class, moved on until no point changes its cluster."""
    points = joined(blocks)
    blocks[:] = parted(points, block_rows(points.x.shape[1]))
    best = None
    for c in _seeds(blocks, k, restarts):
        run = _Run(points, c)
        run.settle(rounds, tolerance)
        found = run.inertia(), run.c
        best = found if best is None or found[0] < best[0] else best
    return _Run(points, best[1]).settle(rounds, 0.0)


def settle_classes(blocks: DataFrame, parts: int, dim: int, k: int, restarts: int, rounds: int, tolerance: float) -> DataFrame:
    """(label, cluster, centroid) of the classes that one task may hold.

    With several ranges a class on average, a class of the usual size or above has a task of its own.
    """
    kind = blocks.schema["label"].dataType

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        held = [opened(*row, dim) for row in zip(table["x"], table["h"], table["lacks"])]
        c = whole_class(held, k, restarts, rounds, tolerance)
        return pa.Table.from_arrays([
            pa.array([key[0].as_py()] * len(c), table["label"].type), pa.array(np.arange(len(c), dtype=np.int32)),
            pa.array(list(c), pa.list_(pa.float64()))], ["label", "cluster", "centroid"])

    held = blocks.filter("whole").select("label", *PARTS).repartitionByRange(parts, "label")
    return held.groupBy("label").applyInArrow(run, f"label {kind.simpleString()}, cluster int, centroid array<double>")


def packed_runs(state: DataFrame) -> DataFrame:
    """All runs of a class in one array."""
    return state.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("restart", "c"))).alias("runs"))


def _each(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Block, list[int], list[np.ndarray]]]:
    """Label, block, and the class's restarts with their centroids."""
    for batch in batches:
        for i in range(batch.num_rows):
            restart, c = batch["runs"][i].values.flatten()
            flat = c.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield (batch["label"].slice(i, 1), opened(*(batch[name][i] for name in PARTS), dim), restart.to_pylist(),
                   np.split(flat, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1]))


def _met(blocks: DataFrame, state: DataFrame) -> tuple[DataFrame, str]:
    return (blocks.select("label", *PARTS).join(small_side(packed_runs(state)), "label"),
            f"label {blocks.schema['label'].dataType.simpleString()}")


def _lists(values: Sequence[np.ndarray]) -> pa.Array:
    return pa.array(list(values), pa.list_(pa.float64()))


def winners(blocks: DataFrame, state: DataFrame, dim: int, step: int) -> DataFrame:
    """(label, restart, won): the next centroid of every run in `state`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, block, restarts, c in _each(batches, dim):
            found = list(drawn(block, c, step))
            if found:
                at, key, h, v = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([label] * len(found)), pa.array([restarts[i] for i in at], pa.int32()),
                    pa.array(key, pa.float64()), pa.array(h, pa.int64()), _lists(v)], ["label", "restart", "key", "h", "v"])

    met, kind = _met(blocks, state)
    won = met.mapInArrow(run, f"{kind}, restart int, key double, h bigint, v array<double>")
    return won.groupBy("label", "restart").agg(F.min_by("v", F.struct("key", "h")).alias("won"))


def moved_runs(blocks: DataFrame, state: DataFrame, dim: int) -> DataFrame:
    """(label, restart, means, inertia): a round of every run in `state`, by task first; means by cluster, with their points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def rows() -> pa.RecordBatch:
            sums, seen, n, inertia = held
            run, cluster = np.nonzero(np.isfinite(c).all(axis=2))
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([key] * len(run)), pa.array(np.asarray(restarts)[run], pa.int32()), pa.array(cluster, pa.int32()),
                pa.array(n[run, cluster]), pa.array(np.where(cluster == 0, inertia[run], 0.0)),
                _lists(sums[run, cluster]), _lists(seen[run, cluster])], ["label", "restart", "cluster", "n", "inertia", "s", "m"])

        for label, block, now, parts in _each(batches, dim):
            if held is not None and label != key:
                yield rows()
                held = None
            if held is None:
                key, restarts, c = label, now, padded(parts, dim)
            found = totals([block], c)
            held = found if held is None else [a + b for a, b in zip(held, found)]
        if held is not None:
            yield rows()

    met, kind = _met(blocks, state)
    mean = F.expr("array(" + ", ".join(f"try_divide(sum(s[{i}]), sum(m[{i}]))" for i in range(dim)) + ")")
    each = met.mapInArrow(
        run, f"{kind}, restart int, cluster int, n double, inertia double, s array<double>, m array<double>")
    each = each.groupBy("label", "restart", "cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), mean.alias("mean"))
    return each.groupBy("label", "restart").agg(
        F.array_sort(F.collect_list(F.struct("cluster", "n", "mean"))).alias("means"), F.sum("inertia").alias("inertia"))
