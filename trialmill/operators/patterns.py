"""Many substrings at once: one reading of a text serves thousands of patterns.

The patterns become one automaton whose moves are a table of (state, kind of character).  A task cuts its
texts into pieces that overlap by the longest pattern, lays them side by side and moves all pieces one character
at a time, so Python does a bounded number of array steps whatever the texts hold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

TABLE_BYTES = 16 * 1024 * 1024
PIECE = 512
BATCH_CHARS = 4 * 1024 * 1024


class Automaton:
    """Moves, and for each state the pattern that ends there and the next state whose pattern ends there too."""

    def __init__(self, patterns: list[tuple[int, str]]):
        letters = sorted({ord(c) for _, text in patterns for c in text})
        self.letters = np.array(letters, np.uint32)
        self.longest = max(len(text) for _, text in patterns)
        kind = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, text in patterns:
            state = 0
            for c in text:
                step = kind[ord(c)]
                if step not in children[state]:
                    children[state][step] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][step]
            ends[state] = number
        self.moves = np.zeros((len(children), len(letters) + 1), np.int32)
        self.ends = np.array(ends, np.int64)
        self.shorter = np.zeros(len(children), np.int32)
        fallback = np.zeros(len(children), np.int32)
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            back = int(fallback[state])
            if state:
                self.moves[state] = self.moves[back]
                self.shorter[state] = back if self.ends[back] >= 0 else self.shorter[back]
            for step, child in children[state].items():
                if state:
                    fallback[child] = self.moves[back, step]
                self.moves[state, step] = child
                waiting.append(child)
        self.reports = (self.ends >= 0) | (self.shorter > 0)

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0).astype(np.int32)

    def found(self, texts: list[str]) -> set[tuple[int, int]]:
        """(index of the text, number of the pattern), each once."""
        pairs: set[tuple[int, int]] = set()
        owners, pieces, held = [], [], 0
        width = max(PIECE, self.longest)  # so that no more than half of a piece is overlap
        for i, text in enumerate(texts):
            for start in range(0, max(len(text) - self.longest + 1, 1), width):
                owners.append(i)
                pieces.append(text[start:start + width + self.longest - 1])
                held += len(pieces[-1]) + 1
                if held >= BATCH_CHARS:
                    pairs |= self._scan(owners, pieces)
                    owners, pieces, held = [], [], 0
        return pairs | self._scan(owners, pieces) if pieces else pairs

    def _scan(self, owners: list[int], pieces: list[str]) -> set[tuple[int, int]]:
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in order])
        owner = np.array(owners)[order]
        codes = np.frombuffer("".join(pieces[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds(codes)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.zeros(len(order), np.int32)
        seen: list[np.ndarray] = []
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            state[:live] = self.moves[state[:live], kinds[starts[:live] + step]]
            hit = np.flatnonzero(self.reports[state[:live]])
            if len(hit):
                seen.append(np.unique(np.stack([owner[hit], state[hit]], axis=1), axis=0))
        pairs: set[tuple[int, int]] = set()
        if not seen:
            return pairs
        at = np.unique(np.concatenate(seen), axis=0)
        while len(at):
            ending = self.ends[at[:, 1]]
            pairs.update(zip(at[ending >= 0, 0].tolist(), ending[ending >= 0].tolist()))
            at = np.stack([at[:, 0], self.shorter[at[:, 1]]], axis=1)
            at = np.unique(at[at[:, 1] > 0], axis=0)
        return pairs


def _table_bytes(states: int, letters: int) -> int:
    return 4 * (states + 1) * (letters + 1)


def dealt(patterns: list[tuple[int, str]], limit: int = TABLE_BYTES) -> list[list[tuple[int, str]]]:
    """Groups of patterns whose tables of moves stay within `limit` bytes; each pattern must do so by itself."""
    groups: list[list[tuple[int, str]]] = []
    states, letters = 0, set()
    for number, text in sorted(patterns, key=lambda p: p[1]):
        more = letters | set(text)
        if groups and _table_bytes(states + len(text), len(more)) <= limit:
            groups[-1].append((number, text))
            states, letters = states + len(text), more
        else:
            groups.append([(number, text)])
            states, letters = len(text), set(text)
    return groups


def contained(texts: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str,
              limit: int = TABLE_BYTES) -> DataFrame:
    """(key, pattern): every distinct pattern each text holds, as `contains` would tell, one row a text and pattern.

    `patterns` is a rule table: its distinct strings go through the driver, so beyond `limit` bytes of text it is refused.  They
    are dealt into groups whose tables of moves take at most `limit` bytes; a task builds the table of its group, and
    each group reads the texts once.  A pattern whose own table would be larger is looked for by itself.
    NULL texts hold nothing, NULL and empty patterns are left out.  Rows of `texts` that repeat are answered row by row.
    """
    distinct = patterns.select(F.col(pattern).alias("p")).where(F.length("p") > 0).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"{size} bytes of patterns are more than {limit}: cut the rule table into parts")
    words = sorted(r.p for r in distinct.collect())
    spark = texts.sparkSession
    out = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField(pattern, T.StringType())])
    rows = texts.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    large = {w for w in words if _table_bytes(len(w), len(set(w))) > limit}

    def scan_for(group):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, names = Automaton(group.value), dict(group.value)
            for batch in batches:
                pairs = sorted(table.found(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64())),
                     pa.array([names[n] for _, n in pairs], pa.string())], names=[key, pattern])
        return scan

    groups = dealt([(i, w) for i, w in enumerate(words) if w not in large], limit)
    passes = [rows.mapInArrow(scan_for(spark.sparkContext.broadcast(group)), out) for group in groups]
    passes += [rows.where(F.contains("_text", F.lit(w))).select(key, F.lit(w).alias(pattern)) for w in sorted(large)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], out)


def rule_check_many(texts: DataFrame, rules: DataFrame, key: str, text: str, rule: str, pattern: str) -> DataFrame:
    """(key, hits, passed): how many distinct patterns each text holds and the rules all of whose patterns it holds, sorted.

    A text without hits has no row; a rule whose patterns are NULL or empty asks for nothing and is left out.
    """
    wanted = rules.where(F.length(pattern) > 0).select(rule, pattern).distinct()
    needs = wanted.groupBy(rule).agg(F.count("*").alias("_needed"))
    hits = contained(texts, wanted, key, text, pattern).distinct()
    counts = hits.groupBy(key).agg(F.count("*").alias("hits"))
    per_rule = hits.join(wanted, pattern).groupBy(key, rule).agg(F.count("*").alias("_held"))
    passed = per_rule.join(needs, rule).where("_held = _needed").groupBy(key).agg(
        F.array_sort(F.collect_list(rule)).alias("passed"))
    return counts.join(passed, key, "left")
