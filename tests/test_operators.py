"""Operators on small fixtures, against hand-worked values or brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.functions import text as tx
from trialmill.operators import clustering, grid, inference, reports, resample, sampling, scoring, tables
from trialmill.sources import files, schemas
from trialmill.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_upsert_keeps_last(spark):
    stored = spark.createDataFrame([("r1", "old", 1), ("r2", "old", 9)], "run_id string, v string, version int")
    new = spark.createDataFrame([("r1", "retry", 1), ("r1", "retry2", 2), ("r3", None, 1)], stored.schema)
    once = tables.upsert(stored, new, ["run_id"], "version")
    assert rows(once) == [("r1", "retry2", 2), ("r2", "old", 9), ("r3", None, 1)]
    assert rows(tables.upsert(once, new, ["run_id"], "version")) == rows(once)


def test_partial_update_writes_null(spark):
    stored = spark.createDataFrame([("r1", 1, 5), ("r2", 2, 6)], "run_id string, a int, b int")
    update = spark.createDataFrame([("r1", None)], "run_id string, b int")
    assert rows(tables.partial_update(stored, update, "run_id", ["b"])) == [("r1", 1, None), ("r2", 2, 6)]


def test_keys_schema_and_snapshot(spark, tmp_path):
    stored = spark.createDataFrame([("r1", 1.0)], "run_id string, tool_f1 double")
    full = tables.ensure_keys(stored, spark.createDataFrame([("r1",), ("r2",)], "run_id string"), "run_id")
    assert rows(full, "run_id") == [("r1", 1.0), ("r2", None)]
    assert dict(tables.evolve(full, schemas.SCORES).dtypes)["functional_correct"] == "boolean"
    assert tables.read_or_empty(spark, f"{tmp_path}/none", schemas.SCORES).count() == 0
    tables.snapshot_once(full, f"{tmp_path}/snap")
    tables.snapshot_once(stored, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 2


def test_corpus_header(spark, tmp_path):
    (tmp_path / "c.csv").write_text(' Utterance,Intent,language,language,word_count,error.1\n"fix, it",debug,go,rust,2,x\n')
    df = files.read_corpus(spark, str(tmp_path / "c.csv"), {"word_count": "int"})
    assert df.columns == ["utterance", "intent", "language", "word_count"]
    assert rows(df) == [("fix, it", "debug", "go", 2)]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"task_id": "a", "sub_intents": ["x"]},\n {"task_id": "b", "cluster": 1}]')
    tasks = files.read_json_records(spark, str(tmp_path / "t.json"), schemas.RAW_TASKS)
    assert rows(tasks.select("task_id", "cluster", "sub_intents"), "task_id") == [("a", None, ["x"]), ("b", 1, None)]
    files.write_csv(spark.createDataFrame([(0.123456,)], "x double"), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).first()[0] == "0.1235"
    files.write_json_array(tasks, f"{tmp_path}/array")
    files.write_json_array(tasks.limit(0), f"{tmp_path}/nothing")
    back = files.read_json_records(spark, f"{tmp_path}/array", schemas.RAW_TASKS)
    assert rows(back, "task_id") == rows(tasks, "task_id")
    assert files.read_json_records(spark, f"{tmp_path}/nothing", schemas.RAW_TASKS).count() == 0
    odd = [(1, ' "a",\n b '), (2, ""), (3, None)]
    files.write_csv(spark.createDataFrame(odd, "id int, ` T.x` string"), f"{tmp_path}/odd")
    assert rows(files.read_corpus(spark, f"{tmp_path}/odd", {"id": "int"}, multi_line=True), "id") == [odd[0], (2, None), odd[2]]
    files.write_json_lines(tasks, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_grid_resume(spark):
    tasks = spark.createDataFrame([("t1", 1), ("t2", 2)], "task_id string, n int")
    full = grid.run_grid(tasks, ["m0", "m1"])
    assert full.count() == 12
    done = full.filter("condition = 'a'").select("run_id", F.when(F.col("model") == "m0", "boom").alias("error"))
    pending = grid.pending_runs(full, done)
    assert pending.count() == 10
    finished = done.filter("error IS NULL").select("run_id")
    assert pending.select("run_id").union(finished).distinct().count() == 12
    assert grid.pilot_grid(tasks, "m0", "n", 1).count() == 3


def test_run_stage(spark):
    def responder(prompt):
        if prompt == "bad":
            raise ValueError("x" * 900)
        return {"response": "TOOL_CALL: read_file(a)"}

    prompts = spark.createDataFrame([("1", "good one"), ("2", "bad")], "run_id string, prompt string")
    got = {r["run_id"]: r for r in grid.finish_runs(grid.run_stage(prompts, responder)).collect()}
    assert got["1"]["tool_sequence"] == '["read_file"]' and got["1"]["input_tokens"] == 2
    assert got["1"]["output_tokens"] == 6 and got["1"]["error"] is None
    assert got["2"]["response"] is None and len(got["2"]["error"]) == 500 and got["2"]["total_tokens"] == 0
    assert got["2"]["tool_calls_json"] == "[]"
    assert got["1"]["timestamp"] is not None and got["2"]["timestamp"] is not None


def test_unscored_includes_reserved(spark):
    runs = spark.createDataFrame([("r1", "x", None), ("r2", "x", None), ("r3", "x", None), ("r4", None, "e")],
                                 "run_id string, response string, error string")
    scores = spark.createDataFrame([("r1", 0.5), ("r2", None)], "run_id string, tool_f1 double")
    assert rows(scoring.unscored_runs(runs, scores).select("run_id")) == [("r2",), ("r3",)]


def test_rules(spark):
    rules = spark.createDataFrame([("t1", False, ["Pay"]), ("t1", True, ["a", "b"])],
                                  "task_id string, ignore_case boolean, any_of array<string>")
    runs = spark.createDataFrame([("1", "t1", "Pay B"), ("2", "t1", "pay b"), ("3", "t2", "Pay B"), ("4", "t1", None)],
                                 "run_id string, task_id string, response string")
    got = scoring.rule_check(runs, rules).select("run_id", "functional_correct")
    assert rows(got) == [("1", True), ("2", False), ("3", None), ("4", False)]


def test_token_stats(spark):
    runs = spark.createDataFrame([(10, 5, True), (20, 5, None), (30, 5, False)], "input_tokens long, output_tokens long, ok boolean")
    got = scoring.token_stats(runs, [], F.col("ok")).first()
    assert (got["total_tokens"], got["avg_input_tokens"], got["successful_tasks"], got["cpstc"]) == (75, 20.0, 1, 75.0)


def test_representatives_and_small_classes(spark):
    near = spark.createDataFrame([(0, 0, 1, 0, 1.0), (0, 0, 2, 3, 1.000005), (0, 0, 3, 9, 1.1), (0, 1, 4, 0, 0.0)],
                                 "label int, cluster int, id long, rich long, distance double")
    got = sampling.cluster_representatives(near, ["label", "cluster"], "distance", "rich", "id")
    assert rows(got.select("cluster", "id")) == [(0, 2), (1, 4)]
    named = sampling.task_ids(got, "label", ["cluster"])
    assert rows(named.select("task_id", "id")) == [("0_001", 2), ("0_002", 4)]
    small = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "intent string, id int")
    assert rows(sampling.small_class_fallback(small, "intent", "id", 6)) == [("a", 1, 0)]
    assert rows(sampling.small_class_fallback(small, "intent", "id", 1)) == [("a", 1, 0), ("b", 2, 0)]
    assert sampling.small_class_fallback(small, "intent", "id", 0).count() == 0


def test_gold_merge_and_master(spark):
    schema = "task_id string, expected_tools array<string>, minimum_required_tools array<string>, has_unit_test boolean"
    first = spark.createDataFrame([("t1", ["a"], ["a"], True), ("t2", ["b"], [], False)], schema)
    later = spark.createDataFrame([("t1", ["z"], ["z"], False)], schema)
    gold = sampling.merge_gold(first, later)
    assert rows(gold.select("task_id", "expected_tools")) == [("t1", ["z"]), ("t2", ["b"])]
    tasks = spark.createDataFrame([("t1", "u"), ("t2", "u"), ("t3", "w")], "task_id string, raw_utterance string")
    report = sampling.quality_report(sampling.tasks_master(tasks, gold), "raw_utterance").first()
    assert (report["n_tasks"], report["empty_minimum"], report["repeated_texts"], report["repeated_ids"]) == (2, 1, 1, 0)
    assert rows(sampling.missing_gold(tasks, gold)) == [("t3", "w")]
    with pytest.raises(ValueError, match="repeated_texts"):
        sampling.assert_quality(sampling.quality_report(sampling.tasks_master(tasks, gold), "raw_utterance"))


# --- statistics ---

X = (.5, .75, 1, .25, .5)
Y = (.25, .5, .75, .25, 0)


def conditions(spark, **groups):
    data = [(f"t{i}", "m", c, float(v)) for c, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(data, "task_id string, model string, condition string, v double")


def test_paired_t(spark):
    got = inference.paired_ttest(conditions(spark, a=Y, c=X), ["task_id", "model"], "v", [("a", "c")]).first()
    assert (got["n"], got["t"], got["p"], got["d"]) == (5, 3.1623, 0.034109, 0.8771)
    assert got["mean_second"] == 0.6 and got["second_high"] == pytest.approx(0.9539, abs=1e-4)
    assert got["significant"] is False


def test_anova_and_tukey(spark):
    df = conditions(spark, a=(.2, .4, .6), b=(.1, .2, .3), c=(.5, .6, .7)).withColumn("intent", F.lit("x"))
    got = inference.one_way_anova(df, ["intent"], "condition", "v", 3).first()
    assert (got["f"], got["p"], got["status"]) == (6.0, 0.037037, "ok")
    few = inference.one_way_anova(df.filter("task_id <> 't0'"), ["intent"], "condition", "v", 3).first()
    assert few["status"] == "insufficient" and few["f"] is None
    q = {(r["first"], r["second"]): r["q"] for r in inference.tukey_q(df, "condition", "v").collect()}
    error = math.sqrt((.04 + .01 + .01) / 3 / 3)
    assert q[("b", "c")] == pytest.approx(.4 / error, abs=1e-3) and len(q) == 3


@pytest.mark.parametrize("b, c, p", [(5, 10, 0.301758), (0, 0, 1), (3, 3, 1), (1, 8, 0.039063)])
def test_mcnemar(spark, b, c, p):
    df = conditions(spark, a=[1] * b + [0] * c + [1, 0], c=[0] * b + [1] * c + [1, 0])
    got = inference.mcnemar_exact(df, ["task_id", "model"], "v").first()
    assert tuple(got)[:4] == (1, b, c, 1) and got["p"] == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("a, b, kappa", [
    ((0, 0, 1, 2, 1, 0), (0, 1, 1, 2, 0, 0), 0.4545), ((0, 0), (0, 0), 1.0), ((0, 1), (1, 0), -1.0), ((), (), 0.0),
])
def test_kappa(spark, a, b, kappa):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    assert inference.cohens_kappa(df, "a", "b").first()["kappa"] == kappa


def test_describe_and_interval_edges(spark):
    df = spark.createDataFrame([("a", float(v)) for v in X] + [("b", 0.3)], "g string, v double")
    a, b = inference.describe_metric(df, ["g"], "v").orderBy("g").collect()
    assert (a["mean"], a["median"], a["n"]) == (0.6, 0.5, 5)
    assert a["std"] == round(statistics.stdev(X), 4)
    assert a["ci_upper"] - a["mean"] == pytest.approx(0.3539, abs=1e-4)
    assert (b["ci_lower"], b["ci_upper"]) == (0.3, 0.3)


def test_exact_median(spark):
    rng = random.Random(3)
    data = {"a": [rng.random() for _ in range(4001)], "b": [1e-300, 1e300, 7.0, 7.0], None: [2.0, None, 5.0], "c": [None],
            "d": [float("-inf"), 1.0, 2.0, float("inf")], "e": [3.0] * 9}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["_key"]["k"]: r["median"] for r in inference.exact_median(inference._value_counts(df, ["k"], "v")).collect()}
    assert got == {"a": statistics.median(data["a"]), "b": 7.0, None: 3.5, "d": 1.5, "e": 3.0}
    assert inference.describe_metric(df, ["k"], "v").count() == 6
    assert inference.describe_metric(df.filter("k = 'e'"), [], "v").first()["median"] == 3.0


def test_relative_lift_matches_published_rows(spark):
    """Published scaffold lift (0.5241 -> 0.7148) and the mean without one model."""
    published = [("m0", "a", 0.4828), ("m1", "a", 0.2306), ("m2", "a", 0.5239),
                 ("m0", "b", 0.2916), ("m1", "b", 0.2368), ("m2", "b", 0.5549),
                 ("m0", "c", 0.5924), ("m1", "c", 0.2201), ("m2", "c", 0.6112)]
    df = spark.createDataFrame(published, "model string, condition string, f1 double")
    got = {r["scope"]: r for r in reports.relative_lift(df, "f1", ["m0", "m1", "m2"]).collect()}
    assert [got["all"][f"mean_{c}"] for c in "abc"] == pytest.approx([0.4124, 0.3611, 0.4746], abs=6e-5)
    assert got["without_m1"]["mean_a"] == pytest.approx(0.50335, abs=6e-5)


def test_cost_identity(spark):
    for mean, successes, published in ((534.7361, 20, 3850.1), (560.8472, 14, 5768.7143), (628.1736, 25, 3618.28)):
        got = spark.range(1).select(scoring.cpstc(F.lit(mean * 144), F.lit(successes))).first()[0]
        assert got == pytest.approx(published, abs=0.01)
    assert spark.range(1).select(scoring.cpstc(F.lit(5), F.lit(0))).first()[0] is None


# --- resampling ---

def brute_bootstrap(tokens, wins, replicates=2000):
    rng = np.random.default_rng(1)
    draws = rng.integers(0, len(tokens), size=(replicates, len(tokens)))
    with np.errstate(divide="ignore"):
        ratio = np.where(wins[draws].sum(1) > 0, tokens[draws].sum(1) / wins[draws].sum(1), np.nan)
    return np.nanpercentile(ratio, [2.5, 97.5])


def test_bootstrap_forms_agree_with_row_resampling(spark):
    rng = np.random.default_rng(7)
    tokens, wins = rng.integers(300, 340, 600), rng.integers(0, 4, 600) // 3
    df = spark.createDataFrame([("g", int(t), int(w)) for t, w in zip(tokens, wins)], "g string, tokens long, wins int")
    low, high = brute_bootstrap(tokens, wins)
    real = tokens.sum() / wins.sum()
    poisson = resample.poisson_ratio(df, ["g"], "tokens", "wins", 800, {"t": "tokens"}).first()
    exact = resample.multinomial_ratio(df, ["g"], "tokens", "wins", 800, blocks=5).first()
    assert poisson["ratio"] == pytest.approx(real) and poisson["t"] == pytest.approx(tokens.mean())
    for got in (poisson, exact):
        assert got["ci_lower"] < real < got["ci_upper"]
        assert got["ci_lower"] == pytest.approx(low, rel=0.06) and got["ci_upper"] == pytest.approx(high, rel=0.06)
    assert tuple(exact) == tuple(resample.multinomial_ratio(df.repartition(7), ["g"], "tokens", "wins", 800, blocks=5).first())


@pytest.mark.parametrize("count", [1, 7, 63, 64, 65, 5000, 10 ** 8])
def test_poisson_draws(count):
    u = resample.uniforms([f"cell {i} " for i in range(40)], 200)
    draws = resample.poisson_draws(np.full(40, count), u)
    assert draws.mean() == pytest.approx(count, abs=5 * math.sqrt(count / 8000))
    assert draws.var() == pytest.approx(count, rel=0.1)


def test_poisson_table_against_sums():
    for mean in (1, 2, 63, 64, 200):
        low, cdf = resample.poisson_table(mean)
        term = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(low + len(cdf))]
        assert np.allclose(cdf, np.cumsum(term)[low:], atol=1e-12) and cdf[-1] == pytest.approx(1, abs=1e-12)


def test_bootstrap_of_close_values_and_missing_ones(spark):
    df = spark.createDataFrame([(None, 1e-7 * i, 1) for i in range(1, 40)] + [("g", None, 1), ("g", 3.0, None), ("g", 5.0, 1)],
                               "g string, x double, y int")
    got = {r["g"]: r for r in resample.poisson_mean(df, ["g"], "x", 300).collect()}
    assert got[None]["ci_lower"] < got[None]["mean"] < got[None]["ci_upper"]
    assert got["g"]["mean"] == 4.0
    assert {r["g"]: r["ratio"] for r in resample.poisson_ratio(df, ["g"], "x", "y", 50).collect()}["g"] == 4.0
    assert resample.poisson_mean(df.limit(0), ["g"], "x", 50).count() == 0


# --- clustering ---

def blobs(spark, per=30):
    rng = random.Random(2)
    data = [(i, i % 2, [10.0 * (i // 2 % 3) + rng.random(), rng.random()]) for i in range(6 * per)]
    return spark.createDataFrame(data, "id long, label int, vec array<double>"), data


def test_kmeans_finds_blobs(spark):
    points, data = blobs(spark)
    assigned, centroids = clustering.kmeans_per_class(points, "label", "id", "vec", 2, k=3, restarts=3, rounds=6)
    found = {r["id"]: r["cluster"] for r in assigned.collect()}
    for label in (0, 1):
        members = [(i, v) for i, l, v in data if l == label]
        assert len({(found[i], int(v[0] // 10)) for i, v in members}) == 3
    assert centroids.count() == 6
    assert found[0] == 0 and found[1] == 0


def test_lost_cluster_starts_at_the_farthest_point(spark):
    points = spark.createDataFrame([(i, 0, 0, [float(x)]) for i, x in enumerate([0, 1, 2, 50])],
                                   "id long, label int, restart int, vec array<double>")
    before = spark.createDataFrame([(0, 0, 0, [1.0]), (0, 0, 1, [-900.0])], "label int, restart int, cluster int, centroid array<double>")
    moved = clustering.lloyd_step(points, before, ["label", "restart"], "vec", 1)
    assert moved.count() == 1
    filled = clustering._refilled(points, before, moved, ["label", "restart"], "id", "vec")
    assert rows(filled.select("cluster", "centroid")) == [(0, [13.25]), (1, [50.0])]


def test_silhouettes_against_pairs(spark):
    points, data = blobs(spark, per=12)
    clustered = points.withColumn("cluster", (F.col("id") % 5).cast("int"))
    got = {r["label"]: r for r in clustering.silhouette_exact(clustered, "label", "cluster", "id", "vec", tile_rows=7).collect()}
    fast = {r["label"]: r for r in clustering.silhouette_fast(clustered, "label", "cluster", "vec", 2).collect()}
    for label in (0, 1):
        members = [(i % 5, np.array(v)) for i, l, v in data if l == label]
        for result, power, name in ((got, 1, "silhouette"), (fast, 2, "silhouette_sq")):
            widths = []
            for x, (c, v) in enumerate(members):
                gaps = {}
                for y, (d, w) in enumerate(members):
                    if x != y:
                        gaps.setdefault(d, []).append(np.linalg.norm(v - w) ** power)
                a = np.mean(gaps[c])
                b = min(np.mean(g) for d, g in gaps.items() if d != c)
                widths.append((b - a) / max(a, b))
            assert result[label][name] == pytest.approx(np.mean(widths), abs=1e-6)
    few = clustered.filter("id < 10")
    assert clustering.silhouette_exact(few, "label", "cluster", "id", "vec").count() == 0


# --- incremental ---

def test_stream_retries_and_replay(spark, tmp_path):
    schema = "run_id string, response string, attempt int"
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def arrive(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)

    def score(batch):
        return batch.select("run_id", "attempt", F.length("response").alias("score"))

    def run():
        stream = incremental.file_stream(spark, str(tmp_path), "in", spark.read.parquet(source).schema)
        incremental.score_stream(stream, score, out, state)
        return rows(incremental.read_scores(spark, out, ["run_id"], ["attempt", "batch"]).select("run_id", "score"))

    arrive(("r1", "abc", 1), ("r2", "a", 1))
    assert run() == [("r1", 3), ("r2", 1)]
    arrive(("r1", "abcde", 2), ("r3", "xy", 1))
    assert run() == [("r1", 5), ("r2", 1), ("r3", 2)]
    assert run() == [("r1", 5), ("r2", 1), ("r3", 2)]


def test_corpus_helpers(spark):
    df = spark.createDataFrame([("um two words", "go", "nan", " "), ("one", None, "x", "e")],
                               "utterance string, language string, framework string, error_type string").withColumn("intent", F.lit("t"))
    assert [r[0] for r in df.select(sampling.entity_richness()).collect()] == [1, 2]
    got = sampling.corpus_profile(df, "utterance", ["intent"]).first()
    assert (got["words_mean"], got["words_max"], got["language_pct"], got["framework_pct"]) == (2.0, 3, 50.0, 50.0)
    assert df.select(tx.count_tokens(F.lit("a, b!"))).first()[0] == 4


def test_small_side_hints_only_small_frames(spark):
    from trialmill.session import planned_bytes, small_side

    small = spark.range(10)
    big = spark.range(10**9)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert planned_bytes(small) < planned_bytes(big)
    assert "ResolvedHint" in plan(small_side(small)) and "ResolvedHint" not in plan(small_side(big))


def test_own_folder_when_session_names_none(spark):
    from trialmill import session

    class Nameless:
        def __init__(self, master):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: {"spark.master": master}.get(key, default))})
            self.sparkContext = type("Context", (), {"applicationId": "app-1"})

    assert session.shared_dir(Nameless("local[2]")) == session.shared_dir(Nameless("local[2]"))
    with pytest.raises(ValueError):
        session.shared_dir(Nameless("spark://host:7077"))
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_rescoring_touches_its_columns_only(spark):
    scores = spark.createDataFrame([("r1", 0.1, True), ("r9", 0.9, None)], "run_id string, tool_f1 double, functional_correct boolean")
    scores = tables.evolve(scores, schemas.SCORES)
    gold = spark.createDataFrame([("t1", ["a"], ["a"], [])], "task_id string, expected_tools array<string>, "
                                 "minimum_required_tools array<string>, alternative_tool_sequences array<array<string>>")
    runs = spark.createDataFrame([("r1", "t1", ["a"], "PAY"), ("r2", "t1", ["b"], "none"), ("r3", "t2", ["a"], "pay")],
                                 "run_id string, task_id string, tool_names array<string>, response string")
    got = scoring.rescore_tools(scores, runs, gold).select("run_id", "tool_f1", "min_req_met", "functional_correct")
    assert rows(got, "run_id") == [("r1", 1.0, 1, True), ("r2", 0.0, 0, None), ("r3", None, None, None), ("r9", 0.9, None, None)]
    rules = spark.createDataFrame([("t1", True, ["pay"])], "task_id string, ignore_case boolean, any_of array<string>")
    got = scoring.rescore_functional(scores, runs, rules).select("run_id", "tool_f1", "functional_correct")
    assert rows(got, "run_id") == [("r1", 0.1, True), ("r2", None, False), ("r3", None, None), ("r9", 0.9, None)]


def test_repeated_update_keys_leave_one_row(spark):
    stored = spark.createDataFrame([("r1", 1, 0), ("r2", 2, 0)], "run_id string, x int, y int")
    twice = spark.createDataFrame([("r1", 3, 1), ("r1", 2, 2)], "run_id string, x int, v int")
    assert rows(tables.partial_update(stored, twice, "run_id", ["x"], version="v")) == [("r1", 2, 0), ("r2", 2, 0)]
    assert rows(tables.partial_update(stored, twice, "run_id", ["x"])) == [("r1", 3, 0), ("r2", 2, 0)]
    keys = spark.createDataFrame([("q",), ("q",), ("r1",)], "run_id string")
    assert sorted(r.run_id for r in tables.ensure_keys(stored, keys, "run_id").collect()) == ["q", "r1", "r2"]


def test_ids_beyond_three_digits_stay_whole(spark):
    from trialmill.operators import sampling
    many = spark.range(1001).selectExpr("'a' AS label", "id")
    ids = {r.task_id for r in sampling.task_ids(many, "label", ["id"]).collect()}
    assert len(ids) == 1001 and {"a_001", "a_100", "a_1000", "a_1001"} <= ids


def test_fractional_costs_are_not_cut(spark):
    from trialmill.operators import resample
    df = spark.createDataFrame([("k", 0.9, 1), ("k", 1.8, 1)], "key string, cost double, hit int")
    assert abs(resample.poisson_ratio(df, ["key"], "cost", "hit", 50).first()["ratio"] - 1.35) < 1e-12
    exact = resample.multinomial_ratio(df, ["key"], "cost", "hit", 200).first()
    assert 0.9 <= exact["ci_lower"] <= 1.35 <= exact["ci_upper"] <= 1.8


def test_a_cluster_needs_a_shared_folder(spark):
    from trialmill import session

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)})

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere())
