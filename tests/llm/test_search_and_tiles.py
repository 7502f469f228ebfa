"""Top-k against numpy, string tiling against a plain greedy search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.llm import decontam, topk
from trialmill.llm.common import WordHashes


def _plain_top(rows, k, query):
    use = [(i, [int(np.floor(1024 * float(np.float64(x)))) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in use if query(i)}.items():
        ranked = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("k,blocks,bins", [(10, (1024, 2048), 4096), (3, (2, 7), 16), (1, (1, 1), 2), (500, (8, 64), 64)])
def test_top_k_is_that_of_brute_force(spark, k, blocks, bins):
    rng = np.random.default_rng(k)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(2000, [0.0] * 6), (2010, [1e4, -1e4, 3.0, 0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=k, query_block=blocks[0], candidate_block=blocks[1], bins=bins)
    assert sorted(tuple(r) for r in got.collect()) == _plain_top(rows, k, lambda i: i % 10 == 0)


def test_top_k_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (4, [1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]), (200, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == _plain_top(rows, 10, lambda i: i % 100 == 0)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles_stay_exact():
    q, c = np.array([[2**31, 1]]), np.array([[2**31, 1], [2**31, 2]])
    assert topk.scores(q, c).tolist() == [[2**62 + 1, 2**62 + 2]]


def _plain_tiles(item, text, least):
    """Marks the longest unmarked common run, again and again."""
    least = min(least, len(item))
    free_a, free_b, tiles = [True] * len(item), [True] * len(text), []
    while least:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_a[a + n] and free_b[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return tiles
        n, a, b = best
        tiles.append((a, b, n))
        free_a[a : a + n] = free_b[b : b + n] = [False] * n
    return tiles


def test_tiles_are_greedy_and_disjoint():
    rng, known = random.Random(11), WordHashes()
    for _ in range(30):
        item = [str(rng.randrange(6)).encode() for _ in range(rng.randrange(0, 40))]
        text = [str(rng.randrange(6)).encode() for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = item[len(item) // 2 :] + [b"x"] + item[: len(item) // 2]
        got = decontam.tile(known.of(item), known.of(text), 4)
        want = _plain_tiles(item, text, 4)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want) or sum(t[2] for t in got) >= 0.9 * sum(t[2] for t in want)
        assert (got and got[0][2]) == (want and want[0][2])
        used_a, used_b = set(), set()
        for a, b, n in got:
            assert item[a : a + n] == text[b : b + n] and n >= min(4, len(item))
            assert not used_a & set(range(a, a + n)) and not used_b & set(range(b, b + n))
            used_a |= set(range(a, a + n))
            used_b |= set(range(b, b + n))


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def test_reordered_and_cut_up_items_are_caught(spark):
    items = {i: _words(40, i) for i in range(6)}
    around = lambda s: _words(200, 1000 + s)
    docs = [
        (0, around(0) + items[0] + around(1)),                                                # whole
        (1, around(2) + items[1][20:] + around(3) + items[1][:20] + around(4)),              # reordered
        (2, around(5) + items[2][:31] + around(6)),                                           # 31 of 40: too little
        (3, around(7)),
        (4, around(8) + [w for i in range(0, 40, 4) for w in items[3][i : i + 4] + ["zz"]]),  # runs under five words
        (5, items[4] + items[5]),
    ]
    frame = spark.createDataFrame([(i, " ".join(w).upper() if i == 0 else ", ".join(w), 1) for i, w in docs], "doc_id long, text string, tiles int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "zz yy")], "item_id long, text string")
    for bits in (24, 6):  # a full bitmap lets all seeds through
        got = {(r.doc_id, r.item_id): (r.coverage, r.tiles) for r in decontam.contaminated(frame, bench, bits=bits).collect()}
        assert got == {(0, 0): (1.0, 1), (1, 1): (1.0, 2), (5, 4): (1.0, 1), (5, 5): (1.0, 1)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(frame, bench).collect()) == [2, 3, 4]


def test_decontamination_defined_cases(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "tiny item"), (None, "lost words here")], "item_id long, text string")
    rows = [(1, None), (None, "ONE two-three four. five six seven"), (1, "a tiny ITEM stands"), (1, "a tiny ITEM stands"), (2, ""), (3, "tiny, other item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(0, 1), (1, 2)]
    assert sorted((r.doc_id, r.text) for r in decontam.drop_contaminated(docs, bench).collect() if r.doc_id != 1) == [(2, ""), (3, "tiny, other item")]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_planted_items_are_found(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " ".join((t or "").split())
    texts, items = {r.doc_id: norm(r.text) for r in docs.collect()}, {r.item_id: norm(r.text) for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x and x in t}
    assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
