"""Bootstrap intervals that do not resample rows one by one.

A resample only matters through how often each distinct value is drawn.  Rows are first
counted per distinct value (one combining aggregate over the facts); the replicates then
work on those cells, so their cost does not grow with the number of rows.

* `poisson_*`: every row is drawn Poisson(1) times, so a cell of n rows is drawn
  Poisson(n) times.  Draws come from md5, hence repeat on any engine and any layout.
* `multinomial_ratio`: exactly as many draws as rows.  Blocks of cells are the leaves of a binary
  tree; a node splits its draws by a binomial generator that md5 of the node starts.  Every block
  walks from the root down to itself, so draws are never shuffled and no key gathers in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

LEVELS = (0.025, 0.975)
CELLS_PER_BLOCK = 10_000
CELLS_AT_A_TIME = 512
#: A draw reads the first 13 hex digits of its md5.
DRAW_BYTES, DRAW_BITS = 7, 52


def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """(k, cdf): the cumulative probabilities of k, k + 1, … under Poisson(mean).

    The table reaches eight spreads and 20 counts to either side of the mean; what lies beyond is less
    than a 52-bit uniform can tell from 0 or 1.  It has 16 * sqrt(mean) + 41 entries at any mean.
    """
    reach = math.ceil(8 * math.sqrt(mean)) + 20
    low = max(0, mean - reach)
    k = np.arange(low, mean + reach + 1, dtype=float)
    steps = math.log(mean) - np.log(np.maximum(k, 1))
    from_mean = np.cumsum(steps) - np.cumsum(steps)[mean - low]
    at_mean = mean * math.log(mean) - mean - math.lgamma(mean + 1)
    return low, np.cumsum(np.exp(at_mean + from_mean))


def uniforms(salts: list[str], replicates: int) -> np.ndarray:
    """One number in (0, 1) per salt and replicate, from md5(salt + number)."""
    numbers = [str(b).encode() for b in range(replicates)]
    digests = bytearray()
    for salt in salts:
        start = hashlib.md5(salt.encode())
        for number in numbers:
            digest = start.copy()
            digest.update(number)
            digests += b"\0" + digest.digest()[:DRAW_BYTES]
    whole = np.frombuffer(bytes(digests), dtype=">u8") >> (8 * DRAW_BYTES - DRAW_BITS)
    return ((whole.astype(float) + 0.5) / 2.0 ** DRAW_BITS).reshape(len(salts), replicates)


def poisson_draws(counts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson(count) per row of `u`, by the inverse of its distribution: one rule for every count."""
    draws = np.empty_like(u)
    for count in np.unique(counts):
        rows = counts == count
        low, cdf = poisson_table(int(count))
        draws[rows] = low + np.searchsorted(cdf, u[rows], side="right")
    return draws


def _salt(column: str) -> Column:
    """A number as text with 12 decimals, as every engine writes it; what does not fit keeps its own form."""
    value = F.col(column)
    return F.coalesce(value.try_cast("decimal(38,12)").cast("string"), value.cast("string"))


def _interval(cells: DataFrame, keys: list[str], salt: list[str], replicates: int, points: list[str]) -> DataFrame:
    """Point values and a percentile interval per key.

    `cells` has `_x, _y, _n`, and arrays `_tops, _bottoms` whose sums give the point values as
    quotients.  A task draws for a few hundred cells at a time and keeps only sums per key and
    replicate, so draws never become rows; the negative replicate numbers stand for the point
    values.  Cells are few bytes and AQE would leave them in one partition; a fixed repartition
    spreads them first.
    """
    spread = cells.repartition(cells.sparkSession.sparkContext.defaultParallelism).select(
        *keys, F.concat_ws("-", *keys, *[_salt(c) for c in salt], F.lit("")).alias("_salt"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("_x", "_y")], "_n", "_tops", "_bottoms")
    types = {f.name: f.dataType.simpleString() for f in spread.schema}
    key_types = "".join(f"`{k}` {types[k]}, " for k in keys)
    at = np.concatenate([np.arange(replicates), -1 - np.arange(len(points))])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), CELLS_AT_A_TIME):
                part = batch.iloc[start:start + CELLS_AT_A_TIME].reset_index(drop=True)
                drawn = poisson_draws(part["_n"].to_numpy(), uniforms(part["_salt"].tolist(), replicates))
                tops = np.hstack([drawn * part[["_x"]].to_numpy(), np.stack(part["_tops"])])
                bottoms = np.hstack([drawn * part[["_y"]].to_numpy(), np.stack(part["_bottoms"])])
                group = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(part))
                for number in np.unique(group):
                    rows = np.flatnonzero(group == number)
                    out = pd.DataFrame({"_b": at, "_top": tops[rows].sum(axis=0), "_bottom": bottoms[rows].sum(axis=0)})
                    for i, k in enumerate(keys):
                        out.insert(i, k, part[k].iloc[rows[0]])
                    yield out

    summed = spread.mapInPandas(sums, f"{key_types}_b int, _top double, _bottom double").groupBy(*keys, "_b").agg(
        F.sum("_top").alias("_top"), F.sum("_bottom").alias("_bottom"))
    estimates = summed.select(*keys, "_b", F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).alias("_q"))
    redraw = F.col("_b") >= 0
    return estimates.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_b") == -1 - i, F.col("_q"))).alias(name) for i, name in enumerate(points)],
        F.percentile(F.when(redraw, F.col("_q")), F.lit(LEVELS[0])).alias("ci_lower"),
        F.percentile(F.when(redraw, F.col("_q")), F.lit(LEVELS[1])).alias("ci_upper"))


def _number(df: DataFrame, column: str) -> Column:
    """The column as it is; flags become 0 and 1."""
    return F.col(column).cast("int") if df.schema[column].dataType.typeName() == "boolean" else F.col(column)


def poisson_ratio(df: DataFrame, keys: list[str], top: str, bottom: str, replicates: int,
                  means: dict[str, str] | None = None) -> DataFrame:
    """`ratio` = sum(top) / sum(bottom) per key with its interval; replicates without
    successes are skipped.  `means` adds plain means (name -> column) from the same pass
    over the facts."""
    means = means or {}
    x, y = _number(df, top), _number(df, bottom)
    total = lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    sums = [total(x), *[total(F.col(c)) for c in means.values()]]
    counts = [total(y), *[F.count(c).cast("double") for c in means.values()]]
    cells = df.groupBy(*keys, x.alias("_x"), y.alias("_y")).agg(
        F.count("*").alias("_n"), F.array(*sums).alias("_tops"), F.array(*counts).alias("_bottoms"))
    return _interval(cells, keys, ["_x", "_y"], replicates, ["ratio", *means])


def poisson_mean(df: DataFrame, keys: list[str], value: str, replicates: int) -> DataFrame:
    """`mean` per key with its interval, one pass over the facts.  Cells are the stored values as they
    are; NULLs are skipped, after counting: a condition on the value would be pushed below its formula and work it
    out a second time for every row."""
    cells = df.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(
        F.count(value).alias("_n"), F.array(F.sum(F.col(value).cast("double"))).alias("_tops"),
        F.array(F.count(value).cast("double")).alias("_bottoms")).where("_n > 0").withColumn("_y", F.lit(1))
    return _interval(cells, keys, ["_x"], replicates, ["mean"])


def rounded(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def mean_with_interval(df: DataFrame, keys: list[str], value: str, replicates: int) -> DataFrame:
    """Mean and bootstrap interval per key, rounded as charts show them."""
    return rounded(poisson_mean(df, keys, value, replicates), ["mean", "ci_lower", "ci_upper"])


def _generator(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest(), "big"))


def _paths(cells: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, _block, _path): rows of each node above the block and of that node's left half, from the root down."""
    leaves = cut_lineage(cells.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_level")
    steps = leaves.select(*keys, "_block", "_n", levels).withColumn("_node", F.expr(f"shiftright(_block, {depth} - _level)"))
    goes_left = F.expr(f"shiftright(_block, {depth - 1} - _level) % 2 = 0")
    at = [*keys, "_level", "_node"]
    nodes = steps.groupBy(*at).agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(goes_left, F.col("_n")).otherwise(0)).alias("_left"))
    nodes = nodes.select(*[F.col(f"`{c}`").alias(f"_at{i}") for i, c in enumerate(at)], "_rows", "_left")
    walked = steps.join(nodes, [F.col(f"`{c}`").eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(at)])
    return walked.groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_level", "_rows", "_left"))).alias("_path"))  # `depth` entries


def multinomial_sums(df: DataFrame, keys: list[str], top: str, bottom: str, replicates: int,
                     blocks: int = 64, seed: int = 42) -> DataFrame:
    """(keys, _b, _sx, _sy): sums of top and bottom in each resample of exactly n of a key's n rows.

    The same rows give the same draws in any layout.  A block holds about `CELLS_PER_BLOCK` cells of a key
    at most, chosen by hash; the tree's sums are a row a node.
    """
    cells = cut_lineage(
        df.groupBy(*keys, _number(df, top).cast("double").alias("_x"), _number(df, bottom).cast("double").alias("_y"))
        .agg(F.count("*").alias("_n"))
    )
    depth = math.ceil(math.log2(max(blocks, cells.count() / CELLS_PER_BLOCK, 2)))
    cells = cells.withColumn("_block", F.pmod(F.xxhash64("_x", "_y"), F.lit(2 ** depth)))
    key_types = "".join(f"`{k}` {cells.schema[k].dataType.simpleString()}, " for k in keys)
    at = [*keys, "_block"]

    def draws_of(name: list, block: int, path: list) -> np.ndarray:
        draws = np.full(replicates, path[0]["_rows"], np.int64)
        for step in path:
            level, rows, left = step["_level"], step["_rows"], step["_left"]
            node = block >> (depth - level)
            lower = _generator(seed, *name, level, node).binomial(draws, left / rows)
            draws = draws - lower if block >> (depth - level - 1) & 1 else lower
        return draws

    def sums(part: pd.DataFrame, walked: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_x", "_y"])
        name, block = list(part[keys].iloc[0]), int(part["_block"].iloc[0])
        weights = part["_n"].to_numpy()
        draws = _generator(seed, *name, "cells", block).multinomial(
            draws_of(name, block, walked["_path"].iloc[0]), weights / weights.sum())
        out = pd.DataFrame({"_b": np.arange(replicates), "_sx": draws @ part["_x"].to_numpy(), "_sy": draws @ part["_y"].to_numpy()})
        for i, k in enumerate(keys):
            out.insert(i, k, part[k].iloc[0])
        return out

    partial = cells.groupBy(*at).cogroup(_paths(cells, keys, depth).groupBy(*at)).applyInPandas(
        sums, f"{key_types}_b int, _sx double, _sy double")
    return partial.groupBy(*keys, "_b").agg(F.sum("_sx").alias("_sx"), F.sum("_sy").alias("_sy"))


def multinomial_ratio(df: DataFrame, keys: list[str], top: str, bottom: str, replicates: int,
                      blocks: int = 64, seed: int = 42) -> DataFrame:
    """Interval of sum(top) / sum(bottom) under resampling of exactly n of n rows; resamples without
    successes are skipped."""
    estimates = multinomial_sums(df, keys, top, bottom, replicates, blocks, seed).where("_sy > 0").withColumn(
        "_estimate", F.col("_sx") / F.col("_sy"))
    return estimates.groupBy(*keys).agg(
        F.percentile("_estimate", F.lit(LEVELS[0])).alias("ci_lower"),
        F.percentile("_estimate", F.lit(LEVELS[1])).alias("ci_upper"))
