import random

import pytest

from trialmill.operators import patterns
from trialmill.operators.patterns import Automaton, contained, dealt, rule_check_many


def plain(texts, words):
    return {(i, n) for i, text in enumerate(texts) for n, word in words if word in text}


def test_overlapping_patterns_and_piece_borders(monkeypatch):
    rng = random.Random(3)
    words = list(enumerate(sorted({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)} | {"he", "she", "hers", "é€"})))
    texts = ["".join(rng.choices("abhers é€", k=rng.choice([0, 1, 5, 40, 700]))) for _ in range(80)]
    want = plain(texts, words)
    assert Automaton(words).found(texts) == want
    for piece, batch in ((1, 70), (16, 300), (100, 1)):
        monkeypatch.setattr(patterns, "PIECE", piece)
        monkeypatch.setattr(patterns, "BATCH_CHARS", batch)
        assert Automaton(words).found(texts) == want


def test_groups_keep_to_the_limit():
    words = list(enumerate(f"word number {i} of many" for i in range(500)))
    groups = dealt(words, 100_000)
    assert len(groups) > 1 and sorted(w for g in groups for w in g) == words
    assert all(Automaton(g).moves.nbytes <= 100_000 for g in groups)


@pytest.mark.parametrize("limit", [1500, 4000, 1 << 24])
def test_contained_is_contains(spark, limit):
    rng = random.Random(limit)
    texts = [(i, "".join(rng.choices("abc ", k=rng.choice([0, 3, 50, 1500])))) for i in range(120)] + [(7, "abcabc"), (None, "aab"), (200, None)]
    words = sorted({"".join(rng.choices("abc ", k=rng.randint(1, 6))) for _ in range(150)})
    table = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],)], "word string")
    got = contained(spark.createDataFrame(texts, "id long, body string"), table, "id", "body", "word", limit)
    rows = sorted(((r.id is None, r.id), r.word) for r in got.collect())
    assert rows == sorted(((i is None, i), w) for i, t in texts if t for w in words if w in t)


def test_too_many_patterns_are_refused_and_none_find_nothing(spark):
    texts = spark.createDataFrame([(1, "abc")], "id long, body string")
    table = spark.createDataFrame([("abc" * 10,)], "word string")
    with pytest.raises(ValueError, match="rule table"):
        contained(texts, table, "id", "body", "word", 20)
    assert contained(texts, table.limit(0), "id", "body", "word").count() == 0
    assert contained(texts.limit(0), table, "id", "body", "word").count() == 0


def test_a_pattern_too_large_for_a_table_is_found(spark):
    long = "".join(chr(97 + i % 26) for i in range(60))
    texts = spark.createDataFrame([(1, "x" + long + "y"), (2, long[:-1]), (3, "abc")], "id long, body string")
    table = spark.createDataFrame([(long,), ("abc",)], "word string")
    got = contained(texts, table, "id", "body", "word", 1000).collect()
    assert sorted((r.id, r.word) for r in got) == [(1, "abc"), (1, long), (2, "abc"), (3, "abc")]


def test_rules_need_all_their_patterns(spark):
    texts = spark.createDataFrame([(1, "import os, def run"), (2, "def run"), (3, "nothing"), (4, None)], "id long, body string")
    rules = spark.createDataFrame([("a", "def"), ("a", "import"), ("b", "def"), ("b", "def"), ("c", None), ("d", "absent")], "rule string, word string")
    got = {r.id: (r.hits, r.passed) for r in rule_check_many(texts, rules, "id", "body", "rule", "word").collect()}
    assert got == {1: (2, ["a", "b"]), 2: (1, ["b"])}
