"""Last attempts in streaming state against a plain reduction: replays, retries, late attempts, a restart, a time-out."""

import random

import pyarrow as pa

from trialmill.streaming import attempts

SCHEMA = "run string, version int, model string, tokens long"
SHAPE = pa.schema([("run", pa.string()), ("version", pa.int64())])


def _plain(rows):
    last = {}
    for run, version, model, tokens in rows:
        if run is not None and version is not None and (run not in last or version > last[run][0]):
            last[run] = (version, model, tokens or 0)
    out = {}
    for _, model, tokens in last.values():
        n, total = out.get(model, (0, 0))
        out[model] = (n + 1, total + tokens)
    return out


def _arrive(spark, tmp_path, rows, idle=attempts.IDLE_MS):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    changes = attempts.attempt_changes(stream, "run", "version", ["model"], ["tokens"], 8, idle)
    attempts.store_changes(changes, ["model"], ["tokens"], str(tmp_path / "out"), str(tmp_path / "state"))
    return {r.model: (r.n, r.tokens) for r in attempts.read_sums(spark, str(tmp_path / "out"), ["model"], ["tokens"]).collect()}


def test_each_restart_goes_on_from_the_state(spark, tmp_path):
    rng = random.Random(5)
    every = []
    for step in range(3):
        rows = [(rng.choice([None, *[f"r{i}" for i in range(40)]]), rng.choice([None, *range(6)]), rng.choice(["m0", "m1", None]), rng.choice([None, 7, 11]))
                for _ in range(60)]
        # equal versions of one run are equal attempts
        rows = [(r, v, "m0" if (hash((r, v)) % 2) else "m1", 7 if v == 3 else 11) if r and v is not None else (r, v, m, t) for r, v, m, t in rows]
        rows += every[-20:]  # a replay
        every += rows
        assert _arrive(spark, tmp_path, rows) == _plain(every)


def test_a_group_that_runs_have_left_is_gone(spark, tmp_path):
    assert _arrive(spark, tmp_path, [("a", 1, "m0", 5), ("b", 1, "m1", None)]) == {"m0": (1, 5), "m1": (1, 0)}
    assert _arrive(spark, tmp_path, [("a", 2, "m1", 6), ("a", 0, "m0", 99)]) == {"m1": (2, 6)}


def test_idle_runs_are_final(spark, tmp_path):
    assert _arrive(spark, tmp_path, [("a", 1, "m0", 5)], idle=-1) == {"m0": (1, 5)}
    assert _arrive(spark, tmp_path, [("a", 2, "m0", 6)], idle=-1) == {"m0": (2, 11)}


def test_attempts_are_taken_in_at_once(spark, tmp_path):
    """No work in Python for a single attempt: many arrivals of a bucket, taken in piece by piece, equal a plain reduction."""
    run = lambda held, new: attempts.take_in(pa.table(held, SHAPE), pa.table(new, SHAPE), "run", "version")
    last, added, gone = run({"run": ["a", "b"], "version": [2, -2**63]}, {"run": ["b", "a", "c", "b", "c"], "version": [0, 2, 1, 2**63 - 1, 1]})
    assert last.to_pylist() == [{"run": "a", "version": 2}, {"run": "c", "version": 1}, {"run": "b", "version": 2**63 - 1}]
    assert added.num_rows == 2 and gone.to_pylist() == [{"run": "b", "version": -2**63}]
    rng = random.Random(6)
    rows = [(f"r{rng.randrange(9000)}", v, f"m{v % 3}", v) for v in [rng.randrange(40) for _ in range(45_000)]]
    assert _arrive(spark, tmp_path, rows) == _plain(rows)
    assert _arrive(spark, tmp_path, rows[:500] + [("r1", 99, "m0", 1)]) == _plain(rows + [("r1", 99, "m0", 1)])
