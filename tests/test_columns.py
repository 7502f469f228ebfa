"""Hand-worked cases for the column functions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trialmill.functions import distributions as dist, text as tx, toolcalls as tc, vectors as vx
from trialmill.operators import scoring

S, R, W, T, X = "search_codebase", "read_file", "write_file", "run_tests", "execute_shell"


def column(spark, values, expression, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize("raw, cleaned", [
    ("um fix the null pointer, you know what i mean", "Fix the null pointer, what."),
    ("So like i'm  stuck AND it's broken", "I am stuck and it is broken."),
    ("unlike well-known ummm right", "Unlike -known."),
    ("   ", ""),
    ("Why can't it run?", "Why cannot it run?"),
    ("éum fix", "Éum fix."),
    ("DON'T they've what's let's", "Do not they have what is let us."),
])
def test_clean_text(spark, raw, cleaned):
    assert column(spark, [raw], tx.clean_text) == [cleaned]


def test_every_contraction_expands(spark):
    from trialmill.fixed_values import CONTRACTIONS

    got = column(spark, list(CONTRACTIONS), tx.expand_contractions)
    assert got == list(CONTRACTIONS.values())


def test_extraction(spark):
    texts = [
        'TOOL_CALL: read_file(path="a(b).py")', "tool_call:READ_FILE ( x )", "TOOL_CALL: git_diff()",
        "TOOL_CALL:\nmade_up(1,\n2)", "TOOL_CALL: git_diff", "TOOL_CALL: outil_été(z)",
    ]
    got = column(spark, texts, tc.extract_tool_calls)
    assert [[tuple(c) for c in row] for row in got] == [
        [("read_file", 'path="a(b', True)], [("read_file", "x", True)], [("git_diff", "", True)],
        [("made_up", "1,\n2", False)], [], [("outil_été", "z", False)],
    ]


def test_validation_and_rates(spark):
    texts = ["TOOL_CALL: read_file(a) TOOL_CALL: nope(b) TOOL_CALL: read_file(c)", "nothing"]
    first, second = column(spark, texts, lambda v: tc.call_validation(tc.extract_tool_calls(v)))
    assert first.asDict() == {"total_calls": 3, "valid_calls": 2, "invalid_calls": 1, "invalid_tool_names": ["nope"],
                              "has_any_tool_call": True, "tool_sequence": [R, R]}
    assert second["has_any_tool_call"] is False
    stored = ['[{"tool":"a","valid":false},{"tool":"b"}]', "[]", "broken", None]
    assert column(spark, stored, tc.tool_halluc_rate) == [0.5, 0.0, 0.0, 0.0]


SEQUENCE_CASES = [
    ([S, R, W, T], (1, 1, 1, 0, 1, 1)), ([R, S, W], (1, 1, 1, 0, 0, 1)), ([R, R, W], (1, 0.6667, 0.8, 1, 1, 0)),
    ([W, R], (1, 0.6667, 0.8, 0, 0, 0)), ([R, W, "made_up"], (0.6667, 0.6667, 0.6667, 0, 1, 0)),
    ([X], (0, 0, 0, 0, 0, 0)), ([], (0, 0, 0, 0, 0, 0)),
]
SCORES = ["tool_precision", "tool_recall", "tool_f1", "redundant_calls", "first_call_correct", "min_req_met"]


def test_best_sequence(spark):
    gold = ([S, R, W, T], [[R, S, W, T], [S, R, W], [R, W, T]], [S, R, W])
    rows = [(i, called, *gold) for i, (called, _) in enumerate(SEQUENCE_CASES)]
    df = spark.createDataFrame(rows, "i int, tool_names array<string>, expected_tools array<string>, "
                               "alternative_tool_sequences array<array<string>>, minimum_required_tools array<string>")
    got = [tuple(r) for r in scoring.with_sequence_scores(df).orderBy("i").select(*SCORES).collect()]
    assert got == [expected for _, expected in SEQUENCE_CASES]


def walk_sequences(called, expected, others, minimum):
    """The same rules as an explicit walk over the candidates."""
    best = (-1.0, 0.0, 0.0)
    starts = False
    for candidate in [expected, *others]:
        hits = len(set(called) & set(candidate))
        p = hits / len(set(called)) if called else 0.0
        r = hits / len(set(candidate)) if candidate else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        first = bool(called) and bool(candidate) and called[0] == candidate[0]
        if f1 > best[0]:
            best, starts = (f1, p, r), first
        elif f1 == best[0]:
            starts = starts or first
    return best, starts, set(minimum) <= set(called)


def test_best_sequence_random(spark):
    rng = random.Random(5)
    draw = lambda low, high: [rng.choice([S, R, W, T, X]) for _ in range(rng.randint(low, high))]
    rows = [(i, draw(0, 6), draw(1, 4), [draw(0, 4) for _ in range(rng.randint(0, 3))], draw(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, tool_names array<string>, expected_tools array<string>, "
                               "alternative_tool_sequences array<array<string>>, minimum_required_tools array<string>")
    got = scoring.with_sequence_scores(df).orderBy("i").collect()
    for row, (_, called, expected, others, minimum) in zip(got, rows):
        (f1, p, r), starts, met = walk_sequences(called, expected, others, minimum)
        assert abs(row["tool_f1"] - f1) < 6e-5 and abs(row["tool_precision"] - p) < 6e-5
        assert abs(row["tool_recall"] - r) < 6e-5
        assert (row["first_call_correct"], row["min_req_met"]) == (int(starts), int(met))


@pytest.mark.parametrize("called, tau", [
    ([S, R, W, T], 1.0), ([T, W, R, S], -1.0), ([R, S, W], 0.3333), ([R, R], 0.0), ([X, S], -1.0),
    ([S, R, R, W], 1.0), ([S], None), ([], None),
])
def test_kendall(spark, called, tau):
    expected = F.array(*[F.lit(t) for t in (S, R, W, T)])
    got, = column(spark, [called], lambda v: tc.kendall_tau(v, expected), "array<string>")
    assert got is None if tau is None else round(got, 4) == tau


def test_kendall_against_pair_count(spark):
    rng = random.Random(3)
    rows = [[rng.randint(0, 4) for _ in range(rng.randint(2, 9))] for _ in range(200)]
    got = column(spark, rows, tc.tau_of_ranks, "array<int>")
    for ranks, tau in zip(rows, got):
        pairs = list(itertools.combinations(zip(ranks, sorted(ranks)), 2))
        sign = lambda v: (v > 0) - (v < 0)
        score = sum(sign(b[0] - a[0]) * sign(b[1] - a[1]) for a, b in pairs)
        free_x = sum(a[0] != b[0] for a, b in pairs)
        free_y = sum(a[1] != b[1] for a, b in pairs)
        assert tau == pytest.approx(score / math.sqrt(free_x * free_y) if free_x else 0.0)


def test_code_block_and_judge(spark):
    texts = ["a\n```python\nx = 1\n```\nb\n```\ny\n```", "```\n```", "  plain ", "```rust\nz```", None]
    assert column(spark, texts, tx.first_code_block) == ["x = 1", "", "plain", "```rust\nz```", ""]
    replies = ['{"score": 2}', 'say {"score": 1.7}\nend', '{"score": "2"}', '{"score": "1.7"}', "none", '{"score": 2} x}',
               '{"x": 1}', None, '{"score": null}', '{"score": 1, "x": {}, "score": "3"}', '{"score": 1, "score": 2, }']
    assert column(spark, replies, lambda v: tx.judge_score(v)[0]) == [2, 1, 2, 0, 0, 0, 0, 0, 0, 3, 0]
    assert column(spark, replies, lambda v: tx.judge_score(v)[1]) == [
        "ok", "ok", "ok", "bad_score", "no_json", "bad_json", "no_score", "no_reply", "bad_score", "ok", "bad_json"]


def test_structured_prompt(spark):
    good = '```json\n{"raw_utterance": "r", "normalized": "n", "intent": "debug", "confidence_score": 0.8, "entities": {"language": "sql"}}\n```'
    got = column(spark, [good, good + " tail", "[1]", "{'a': 1}"], lambda v: tx.parse_structured_prompt(v, F.lit("raw")))
    assert (got[0]["normalized"], got[0]["entities"]["language"], got[0]["_parse_error"]) == ("n", "sql", None)
    for bad in got[1:]:
        assert (bad["normalized"], bad["intent"], bad["confidence_score"]) == ("raw", "unknown", 0.0)
        assert bad["_parse_error"]


def test_prompt_rendering(spark):
    prompt, = column(spark, ["x"], lambda v: tx.render_prompt(F.lit("a"), v, F.struct(v.alias("raw"))))
    assert prompt == "Developer request:\n\nx"
    prompt, = column(spark, ["x"], lambda v: tx.render_prompt(F.lit("c"), v, F.struct(v.alias("raw"))))
    assert prompt == 'Structured developer request (JSON):\n\n{"raw":"x"}'


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(vx.cosine_similarity(a, b), vx.norm(vx.l2_normalize(a)), vx.squared_distance(a, b)).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == pytest.approx(1.0) and got[0][2] == pytest.approx(2.0)
    assert got[1][0] == 0.0 and got[1][1] == 0.0


def t_tail(t, df, steps=20_000):
    """Two-sided tail by Simpson's rule on the density."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    height = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    h = t / steps
    inside = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * height(i * h) for i in range(steps + 1)) * h / 3
    return 1 - 2 * inside


def test_distributions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    for t, df in ((2.228139, 10), (1.976692, 143), (12.7062, 1), (1.962339, 1000)):
        assert value(dist.t_two_sided(lit(t), lit(df))) == pytest.approx(0.05, abs=2e-6)
        assert value(dist.t_critical(lit(df))) == pytest.approx(t, abs=2e-5)
    for df in (1, 2, 7, 30, 199, 200, 201, 5000):
        assert value(dist.t_two_sided(lit(1.3), lit(df))) == pytest.approx(t_tail(1.3, df), abs=1e-9)
    assert value(dist.t_two_sided(lit(40.0), lit(10**12))) < 1e-300
    assert value(dist.normal_two_sided(lit(1.959963984540054))) == pytest.approx(0.05, abs=1e-12)
    assert value(dist.normal_two_sided(lit(5.0))) == pytest.approx(5.733031e-7, rel=1e-6)
    assert value(dist.f_tail(lit(3.885294), lit(2), lit(12))) == pytest.approx(0.05, abs=1e-6)
    assert value(dist.f_tail(lit(3.490295), lit(3), lit(12))) == pytest.approx(0.05, abs=1e-6)
    assert value(dist.f_tail(lit(3.259167), lit(4), lit(12))) == pytest.approx(0.05, abs=1e-6)
    assert value(dist.f_tail(lit(3.105875), lit(5), lit(12))) == pytest.approx(0.05, abs=1e-6)
    for b, c, p in ((5, 10, 0.301758), (0, 0, 1), (3, 3, 1), (1, 8, 0.039063)):
        assert value(dist.binomial_two_sided_half(lit(min(b, c)), lit(b + c))) == pytest.approx(p, abs=1e-6)
    cases = [(k, n) for n in (1, 2, 3, 9, 100, 1001, 99_999, 100_000, 100_001)
             for k in sorted({0, n // 3, max(0, n // 2 - int(n ** 0.5)), n // 2})]
    frame = spark.createDataFrame(cases, "k long, n long")
    for k, n, got in frame.select("k", "n", dist.binomial_two_sided_half(F.col("k"), F.col("n"))).collect():
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        exact = min(1.0, 2 * math.fsum(map(math.exp, logs)))
        assert got == pytest.approx(exact, rel=1e-7, abs=1e-300)
    # far out a binomial is normal
    far = value(dist.binomial_two_sided_half(lit(10**12 // 2 - 10**6), lit(10**12)))
    assert far == pytest.approx(0.0455003, abs=1e-6)
    freedoms = spark.createDataFrame([(d,) for d in (1, 2, 3, 199, 200, 201, 202, 10**6)], "df long")
    back = freedoms.withColumn("t", dist.t_critical(F.col("df"))).select(dist.t_two_sided(F.col("t"), F.col("df")))
    for row in back.collect():
        assert row[0] == pytest.approx(0.05, rel=1e-9)
