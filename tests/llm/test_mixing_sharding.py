"""Pareto mixing and the lookup table against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trialmill.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 0) for i, t, s in rows], SCHEMA)


def _fill(sizes, weights, share, most):
    """Targets by the stated rule: share by weight, cut at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        given = {s: target[s] + left * weight[s] / whole for s in open_}
        left = sum(max(0.0, given[s] - most * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(given[s], most * sizes[s])
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


@pytest.mark.parametrize("n_sources", [3, 7])
def test_sources_meet_their_targets(spark, n_sources):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 90 + (3000 if i == 5 else 0))), f"s{min(i % n_sources, i % 3)}") for i in range(400)]
    got = mixing.pareto_mix(_docs(spark, rows)).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = _fill(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.0
    again = mixing.pareto_mix(_docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_longer_documents_are_less_likely(spark):
    rows = [(i, " ".join(["w"] * (40 if i % 10 else 4000)), "a") for i in range(2000)]
    got = mixing.pareto_mix(_docs(spark, rows), share=0.5).collect()
    share = {long: sum(r.taken for r in got if (r.size > 100) == long) / sum(r.size for r in got if (r.size > 100) == long) for long in (True, False)}
    assert share[True] < share[False]


def test_mixing_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", None), (None, "x y z", None), (3, "one two", None), (3, "one two", None), (4, " \t\n", "b")]
    got = mixing.pareto_mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) == pytest.approx(15, abs=2)
    assert mixing.pareto_mix(_docs(spark, [])).count() == 0
    assert all(r.taken == 0 for r in mixing.pareto_mix(_docs(spark, [(1, None, None)])).collect())


def test_repeated_rows_become_copies(spark):
    docs = _docs(spark, [(i, "a b c", "s") for i in range(10)])
    out = mixing.repeat_rows(mixing.pareto_mix(docs).drop("size"). withColumn("size", F.lit(3).cast("long")))
    assert out.count() == 15 and max(Counter(r.doc_id for r in out.collect()).values()) == 2


def _claim(names, slots):
    """The rule again, with whole preference lists."""
    lists = []
    for n in names:
        offset, skip = sharding.preferences(n, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    assert all(sorted(x) == list(range(slots)) for x in lists)
    owner, turn = {}, 0
    while len(owner) < slots:
        mine = lists[turn % len(names)]
        owner[next(s for s in mine if s not in owner)] = turn % len(names)
        turn += 1
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("names,slots", [(["a"], 7), (["a", "b", "c"], 13), (sharding.shard_names(10), 211)])
def test_table_is_claimed_in_turns(names, slots):
    got = sharding.fill_table(names, slots)
    assert got == _claim(names, slots)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = sharding.shard_names(20)
    before, after = sharding.fill_table(names, 4093), sharding.fill_table(names[:-1], 4093)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.1 * 4093


def test_placing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = sharding.shard_names(8)
    got = sharding.place(docs.withColumn("shard", F.lit("clash")), names).collect()
    table = sharding.fill_table(names)
    assert len(got) == docs.count() and all(r.shard == names[table[r.slot]] for r in got)
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (None, None), (1, "x"), (1, "y")], "doc_id long, text string")
    by = defaultdict(set)
    for r in sharding.place(odd, names).collect():
        by[r.doc_id, r.text if r.doc_id is None else ""].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    assert sharding.place(odd.limit(0), names).count() == 0


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a"], 9), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(names, slots)
