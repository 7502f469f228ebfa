"""Every registered query: key -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed_values import CONDITIONS
from ..functions import text as tx, toolcalls as tc, vectors as vx
from ..operators import clustering, frontier, grid, inference, patterns, rankcorr, reports, resample, sampling, scoring, tables
from ..session import cut_lineage, forget, large_side, shared_dir, shares
from ..sources import files, schemas
from ..streaming import attempts, incremental
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DIM = 64
CI_REPLICATES = 200
#: A run's key with the task that its rows are dealt by: joins on both need no further shuffle.
RUN = ["task_id", "run_id"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _joined(names) -> Column:
    return F.array_join(names, ",")


# --- table maintenance -------------------------------------------------------------

@query
def schema_evolve_scores(spark, sf):
    old = b.runs(spark, sf).select("run_id", F.col("planned_calls").alias("total_tool_calls"))
    return tables.evolve(old, schemas.SCORES).select(
        "run_id", "total_tool_calls", "tool_f1", "intent_fidelity_score", "functional_correct")


def _versioned(runs: DataFrame, version: int) -> DataFrame:
    return runs.select(*RUN, "model", "condition", "total_tokens", "error", F.lit(version).alias("version"))


@query
def upsert_results(spark, sf):
    runs = b.runs(spark, sf)
    again = runs.filter(F.col("error").isNotNull() | (F.col("topic") == "purchase"))
    retry = _versioned(again.withColumns({"total_tokens": F.col("total_tokens") + 7, "error": F.lit(None).cast("string")}), 2)
    late = _versioned(again.filter(F.col("k") > 50).withColumn("total_tokens", F.col("total_tokens") + 11), 3)
    merged = tables.upsert(_versioned(runs, 1), retry.unionByName(late), ["run_id"], "version", dealt_by="task_id")
    return merged.drop("task_id").withColumn("version", F.col("version").cast("long"))


def _thin_scores(runs: DataFrame) -> DataFrame:
    good = runs.filter(F.col("error").isNull())
    return good.select(*RUN, "topic", F.col("planned_calls").alias("total_tool_calls"),
                       (F.col("k") % 4).cast("long").alias("intent_fidelity_score"))


@query
def partial_update_scores(spark, sf):
    scores = _thin_scores(b.runs(spark, sf))
    update = scores.filter(F.col("topic") == "view").select(
        *RUN, F.when(F.col("total_tool_calls") > 2, F.lit(3).cast("long")).alias("intent_fidelity_score"))
    return tables.partial_update(scores.drop("topic"), update, RUN, ["intent_fidelity_score"]).drop("task_id")


@query
def ensure_score_keys(spark, sf):
    runs = b.runs(spark, sf)
    stored = _thin_scores(runs).filter(F.col("topic") != "signup").drop("topic")
    return tables.ensure_keys(stored, runs.filter(F.col("error").isNull()), RUN).drop("task_id")


@query
def task_lookup(spark, sf):
    ids = [f"task_{n:012d}" for n in (3, 102, 203, 304, 403, 502, 605, 701)]
    return tables.lookup(b.tasks(spark, sf), "task_id", ids).select("task_id", "intent", "topic", F.col("k").cast("long").alias("k"))


# --- files ---

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trialmill-{name}-{uuid.uuid4().hex}"


@query
def corpus_from_csv(spark, sf):
    """Documents as a CSV with untidy names and a repeated column, read back as a corpus."""
    folder = _folder(spark, "corpus")
    untidy = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias(" Doc_ID"), F.col("text").alias("Utterance "), F.col("lang").alias("language"),
        F.col("source").alias("Language.1"), F.col("n_chars").alias("N_Chars"), (F.col("n_chars") / 7.0).alias("share"))
    files.write_csv(untidy, folder)
    return files.read_corpus(spark, folder, {"doc_id": "bigint", "n_chars": "bigint", "share": "double"}, multi_line=True)


@query
def records_from_json(spark, sf):
    """Conversation turns as JSON arrays, read back by schema."""
    folder = _folder(spark, "turns")
    turns = b.table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    files.write_json_array(turns, folder)
    return files.read_json_records(spark, folder, turns.schema)


@query
def records_from_json_lines(spark, sf):
    folder = _folder(spark, "items")
    items = b.table(spark, sf, "benchmark").select("item_id", "text", F.split("text", " ").alias("words"))
    files.write_json_lines(items, folder)
    return spark.read.schema(items.schema).json(folder).select(
        "item_id", "text", F.size("words").cast("long").alias("n_words"))


@query
def score_snapshot(spark, sf):
    """The score table from its first use on: made, filled, copied aside once, and changed after that."""
    folder = _folder(spark, "scores")
    table, kept = f"{folder}/scores", f"{folder}/original"
    first = tables.evolve(_thin_scores(b.runs(spark, sf)).drop("topic", "task_id"), schemas.SCORES)
    tables.read_or_empty(spark, table, schemas.SCORES).unionByName(first).write.parquet(table)
    stored = tables.read_or_empty(spark, table, schemas.SCORES)
    tables.snapshot_once(stored, kept)
    tables.snapshot_once(stored.withColumn("total_tool_calls", F.lit(0).cast("long")), kept)
    return spark.read.parquet(kept).select("run_id", "total_tool_calls", "intent_fidelity_score", "tool_f1")


# --- task sampling -----------------------------------------------------------------

@query
def intent_distribution(spark, sf):
    return sampling.intent_distribution(b.utterances(spark, sf))


@query
def corpus_profile(spark, sf):
    return sampling.corpus_profile(b.utterances(spark, sf), "utterance", ["intent"])


@query
def entity_richness(spark, sf):
    return b.utterances(spark, sf).select("doc_id", sampling.entity_richness().alias("entity_count"))


@query
def embedding_normalize(spark, sf):
    unit = b.vectors_frame(spark, sf).withColumn("u", vx.l2_normalize(F.col("vec")))
    spread = F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return unit.select("vec_id", F.round(vx.norm(F.col("u")), 6).alias("unit_norm"), F.round(spread, 6).alias("weighted_sum"))


def _start_centroids(points: DataFrame) -> DataFrame:
    return clustering.centroids_of(points, ["label", "cluster"], "vec", DIM)


@query
def lloyd_step(spark, sf):
    points = b.vectors_frame(spark, sf)
    moved = clustering.lloyd_step(points.drop("cluster"), _start_centroids(points), ["label"], "vec", DIM)
    spread = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return moved.select(F.col("label").cast("long").alias("label"), F.col("cluster").cast("long").alias("cluster"), "n",
                        F.round("inertia", 6).alias("inertia"), F.round(spread, 6).alias("weighted_sum"))


@query
def kmeans_per_class(spark, sf):
    points = b.vectors_frame(spark, sf).drop("cluster")
    assigned, _ = clustering.kmeans_per_class(points, "label", "vec_id", "vec", DIM)
    return assigned.groupBy("label", "cluster").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_member"), F.round(F.sum("d2"), 6).alias("inertia"))


@query
def kmeans_fixpoint(spark, sf):
    """What holds for a finished K-Means: every point lies nearest to the mean of its own cluster."""
    points = b.vectors_frame(spark, sf).drop("cluster")
    assigned, _ = clustering.kmeans_per_class(points, "label", "vec_id", "vec", DIM)
    own = assigned.select("label", "vec_id", "vec", F.col("cluster").alias("own"))
    means = clustering.centroids_of(own.withColumnRenamed("own", "cluster"), ["label", "cluster"], "vec", DIM)
    nearest = clustering.assign(own, means, ["label"], "vec")
    return nearest.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(F.col("cluster") != F.col("own")).alias("misplaced"),
        F.count_distinct("own").alias("clusters"))


def _distances(points: DataFrame) -> DataFrame:
    return clustering.centroid_distance(points, _start_centroids(points), ["label", "cluster"], "vec")


@query
def centroid_distance(spark, sf):
    return _distances(b.vectors_frame(spark, sf)).select("vec_id", F.round("distance", 6).alias("distance"))


def _representatives(spark, sf) -> DataFrame:
    near = _distances(b.vectors_frame(spark, sf)).select("label", "cluster", "vec_id", "entity_count", "distance")
    return sampling.cluster_representatives(near, ["label", "cluster"], "distance", "entity_count", "vec_id")


@query
def cluster_representatives(spark, sf):
    return _representatives(spark, sf).select(
        F.col("label").cast("long").alias("label"), F.col("cluster").cast("long").alias("cluster"), "vec_id",
        F.round("distance", 6).alias("distance"))


@query
def task_ids(spark, sf):
    return sampling.task_ids(_representatives(spark, sf), "label", ["cluster"]).select("task_id", "vec_id")


@query
def append_composites(spark, sf):
    selected = sampling.raw_task(b.utterances(spark, sf)).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("task_id"), "intent",
        F.length("utterance").cast("long").alias("n_chars"), "entities_in_source",
        F.lit(0).cast("int").alias("cluster"))
    composites = b.table(spark, sf, "benchmark").select(
        F.concat(F.lit("composite_"), F.col("item_id").cast("string")).alias("task_id"), F.lit("composite").alias("intent"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(F.lit("debug"), F.lit("test")).alias("sub_intents"))
    out = sampling.append_composites(selected, composites)
    return out.select("task_id", "intent", "n_chars", "source", F.col("cluster").cast("long").alias("cluster"),
                      _joined("sub_intents").alias("sub_intents"),
                      F.col("entities_in_source.language").alias("language"),
                      F.col("entities_in_source.framework").alias("framework"),
                      F.col("entities_in_source.error_type").alias("error_type"))


@query
def small_classes(spark, sf):
    """Documents alone in their class (here: their length)."""
    docs = b.table(spark, sf, "documents").select("n_chars", "doc_id", "source")
    return sampling.small_class_fallback(docs, "n_chars", "doc_id", 6).withColumn("cluster", F.col("cluster").cast("long"))


@query
def merged_gold(spark, sf):
    gold = b.gold(spark, sf).select("task_id", "expected_tools", "minimum_required_tools")
    later = gold.filter(F.size("expected_tools") > 3).withColumn("expected_tools", F.col("minimum_required_tools"))
    return sampling.merge_gold(gold, later).select("task_id", _joined("expected_tools").alias("expected"))


def _master(spark, sf) -> DataFrame:
    tasks = b.tasks(spark, sf).select("task_id", "intent", "topic", "k")
    return sampling.tasks_master(tasks, b.gold(spark, sf))


@query
def tasks_master(spark, sf):
    return _master(spark, sf).select(
        "task_id", "intent", _joined("gold_standard.expected_tools").alias("expected"),
        _joined("gold_standard.minimum_required_tools").alias("minimum"),
        F.size("gold_standard.alternative_tool_sequences").cast("long").alias("alternatives"), "has_unit_test")


@query
def missing_gold(spark, sf):
    return sampling.missing_gold(b.tasks(spark, sf), b.gold(spark, sf)).select("task_id", "intent")


@query
def task_quality_report(spark, sf):
    text = F.concat("topic", F.lit(" "), F.col("k").cast("string"), F.lit(" "), "intent")
    known = F.when(F.size("expected_tools") > 2, F.array(F.size("minimum_required_tools").cast("float")))
    gold = b.gold(spark, sf).withColumn("intent_preservation_embedding", known)
    master = sampling.tasks_master(b.tasks(spark, sf).select("task_id", "intent", "topic", "k"), gold)
    return sampling.quality_report(master.withColumn("raw_utterance", text), "raw_utterance",
                                   "gold_standard.intent_preservation_embedding")


@query
def silhouette_exact(spark, sf):
    points = b.vectors_frame(spark, sf)
    assigned = clustering.assign(points.drop("cluster"), _start_centroids(points), ["label"], "vec")
    out = clustering.silhouette_exact(assigned, "label", "cluster", "vec_id", "vec")
    return out.withColumn("label", F.col("label").cast("long"))


@query
def silhouette_fast(spark, sf):
    points = b.vectors_frame(spark, sf)
    assigned = clustering.assign(points.drop("cluster"), _start_centroids(points), ["label"], "vec")
    out = clustering.silhouette_fast(assigned, "label", "cluster", "vec", DIM)
    return out.withColumn("label", F.col("label").cast("long"))


# --- prompt variants ---------------------------------------------------------------

@query
def expand_contractions(spark, sf):
    u = b.utterances(spark, sf)
    return u.select("doc_id", tx.expand_contractions(F.lower("utterance")).alias("expanded"))


@query
def strip_fillers(spark, sf):
    return b.utterances(spark, sf).select("doc_id", tx.strip_fillers(F.lower("utterance")).alias("stripped"))


@query
def clean_text(spark, sf):
    return b.utterances(spark, sf).select("doc_id", tx.clean_text(F.col("utterance")).alias("cleaned"))


def _structured(spark, sf) -> DataFrame:
    replies = b.structured_replies(spark, sf)
    return replies.withColumn("c", tx.parse_structured_prompt(F.col("reply"), F.col("raw"), F.col("api_error")))


@query
def parse_structured_prompt(spark, sf):
    return _structured(spark, sf).select(
        "task_id", F.col("c.normalized").alias("normalized"), F.col("c.intent").alias("intent"),
        F.col("c.confidence_score").alias("confidence"), F.col("c.entities.component").alias("component"),
        F.col("c._parse_error").isNotNull().alias("parse_failed"), F.col("c._api_error").alias("api_error"))


@query
def condition_failures(spark, sf):
    failed = _structured(spark, sf).filter(F.col("c._parse_error").isNotNull() | F.col("c._api_error").isNotNull())
    return failed.select("task_id", F.coalesce("c._parse_error", "c._api_error").alias("reason"))


def _wide_conditions(spark, sf) -> DataFrame:
    u = b.utterances(spark, sf)
    cleaned = u.withColumn("condition_b", tx.clean_text(F.col("utterance")))
    structured = F.struct(
        F.col("utterance").alias("raw_utterance"), F.col("condition_b").alias("normalized"), "intent",
        F.struct(sampling.clean_entity(F.col("error_type")).alias("error_type"), F.col("language")).alias("entities"))
    return cleaned.select("doc_id", "intent", F.col("utterance").alias("condition_a"), "condition_b",
                          structured.alias("condition_c"))


def _long_conditions(spark, sf) -> DataFrame:
    wide = _wide_conditions(spark, sf)
    asked = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"condition_{c}").alias("plain")) for c in "ab"],
                    F.struct(F.lit("c").alias("condition"), F.lit(None).cast("string").alias("plain")))
    return wide.select("doc_id", "condition_c", F.explode_outer(asked).alias("v")).select("doc_id", "condition_c", "v.*")


@query
def conditions_long(spark, sf):
    body = F.when(F.col("condition") == "c", F.col("condition_c.normalized")).otherwise(F.col("plain"))
    return _long_conditions(spark, sf).select("doc_id", "condition", body.alias("prompt_text"))


@query
def render_prompt(spark, sf):
    prompt = tx.render_prompt(F.col("condition"), F.col("plain"), F.col("condition_c"))
    return _long_conditions(spark, sf).select("doc_id", "condition", prompt.alias("prompt"))


# --- run grid ----------------------------------------------------------------------

@query
def run_grid(spark, sf):
    return grid.run_grid(b.tasks(spark, sf), b.MODELS).select("run_id", "task_id", "model", "condition")


@query
def pilot_grid(spark, sf):
    return grid.pilot_grid(b.tasks(spark, sf), "m1", "task_no").select("run_id", "task_id", "model", "condition")


@query
def pending_runs(spark, sf):
    done = b.runs(spark, sf).filter(F.col("topic") != "click")
    todo = grid.pending_runs(grid.run_grid(b.tasks(spark, sf), b.MODELS), done, RUN)
    return todo.select("run_id", "task_id", "model", "condition")


@query
def bucketed_pending(spark, sf):
    """Grid and run log stored by run, so that a resumed experiment finds what is left without a shuffle."""
    done = tables.bucketed(b.runs(spark, sf).filter(F.col("topic") != "click").select("run_id", "error"), "run_id")
    planned = tables.bucketed(grid.run_grid(b.tasks(spark, sf), b.MODELS).select("run_id", "task_id", "model", "condition"), "run_id")
    return grid.pending_runs(planned, done).select("run_id", "task_id", "model", "condition")


def echo_model(prompt: str) -> dict:
    """Stand-in responder: deterministic, fails on prompts about errors."""
    if "error" in prompt:
        raise RuntimeError("refused: " + prompt)
    reply = f"TOOL_CALL: read_file(n={len(prompt)})\nTOOL_CALL: made_up(x)\ndone"
    return {"response": reply, "input_tokens": len(prompt)}


@query
def run_stage_stub(spark, sf):
    prompt = F.concat(F.lit("Developer request:\n\n"), F.col("topic"), F.lit(" "), F.col("k").cast("string"))
    asked = grid.run_grid(b.tasks(spark, sf).withColumn("prompt", prompt), b.MODELS).select("run_id", "prompt")
    done = grid.finish_runs(grid.run_stage(asked, echo_model))
    return done.select("run_id", "response", "input_tokens", "output_tokens", "total_tokens", "tool_sequence",
                       "total_tool_calls", "error")


def refuse(prompt: str) -> dict:
    """Stand-in responder that fails with the prompt as its message."""
    raise RuntimeError(prompt)


@query
def error_rows(spark, sf):
    asked = b.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    done = grid.finish_runs(grid.run_stage(asked, refuse))
    return done.select("doc_id", "response", "total_tokens", "tool_calls_json", "error")


@query
def token_usage(spark, sf):
    docs = b.utterances(spark, sf)
    usage = F.when(F.col("language") == "en", F.col("n_chars"))
    return docs.select("doc_id", F.coalesce(usage, tx.count_tokens(F.col("utterance"))).alias("tokens"))


@query
def run_status(spark, sf):
    return grid.run_status(b.runs(spark, sf), ["model"])


# --- tool calls --------------------------------------------------------------------

def _called(spark, sf) -> DataFrame:
    return b.with_calls(b.runs(spark, sf))


@query
def extract_tool_calls(spark, sf):
    return tc.explode_calls(_called(spark, sf), ["run_id"]).select("run_id", F.col("pos").cast("long").alias("pos"), "tool", "params", "valid")


@query
def valid_calls(spark, sf):
    return _called(spark, sf).select("run_id", _joined(tc.valid_names(F.col("tool_calls"))).alias("tools"))


@query
def call_validation(spark, sf):
    v = _called(spark, sf).select("run_id", tc.call_validation(F.col("tool_calls")).alias("v"))
    return v.select("run_id", "v.total_calls", "v.valid_calls", "v.invalid_calls", "v.has_any_tool_call",
                    _joined("v.invalid_tool_names").alias("invalid_tool_names"),
                    _joined("v.tool_sequence").alias("tool_sequence"))


@query
def redundant_calls(spark, sf):
    names = F.coalesce(tc.tool_names(F.col("response")), F.array().cast("array<string>"))
    return b.runs(spark, sf).select("run_id", names.alias("n")).select(
        "run_id", tc.redundant_calls(F.col("n")).alias("redundant"))


@query
def tool_halluc_rate(spark, sf):
    stored = _called(spark, sf).select("run_id", F.to_json("tool_calls").alias("calls_json"))
    return stored.select("run_id", F.round(tc.tool_halluc_rate(F.col("calls_json")), 6).alias("rate"))


@query
def format_compliance(spark, sf):
    called = b.runs(spark, sf).withColumn("n", F.coalesce(F.size(tc.tool_names(F.col("response"))), F.lit(0)))
    flagged = called.withColumn("ok", tc.format_compliance(F.col("n")))
    return flagged.groupBy("model", "condition").agg(F.round(F.avg("ok"), 4).alias("format_compliance"))


# --- scoring -----------------------------------------------------------------------

def _slim(spark, sf) -> DataFrame:
    good = b.runs(spark, sf).filter(F.col("error").isNull())
    return good.select("run_id", "task_id", tc.tool_names(F.col("response")).alias("tool_names")).join(
        large_side(scoring.with_candidates(b.gold(spark, sf))), "task_id")


@query
def best_sequence_f1(spark, sf):
    return scoring.with_sequence_scores(_slim(spark, sf)).select(
        "run_id", "tool_precision", "tool_recall", "tool_f1", "total_tool_calls", "redundant_calls")


@query
def first_call_correct(spark, sf):
    return scoring.with_sequence_scores(_slim(spark, sf)).select("run_id", "first_call_correct")


@query
def min_req_met(spark, sf):
    return scoring.with_sequence_scores(_slim(spark, sf)).select("run_id", "min_req_met")


@query
def cosine_similarity(spark, sf):
    v = b.vectors_frame(spark, sf).select("vec_id", "vec", vx.norm(F.col("vec")).alias("length"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"), F.col("length").alias("other_length"))
    value = vx.cosine_from(vx.dot(F.col("vec"), F.col("other")), F.col("length"), F.col("other_length"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(value, 6).alias("cosine"))


@query
def intent_preservation(spark, sf):
    v = b.vectors_frame(spark, sf)
    gold = v.groupBy("label").agg(F.min_by("vec", "vec_id").alias("gold_embedding"))
    scored = scoring.intent_preservation(v.withColumnRenamed("vec", "embedding"), gold, "label")
    return scored.select("vec_id", F.round("intent_preservation", 6).alias("intent_preservation"))


@query
def judge_score_parse(spark, sf):
    score, status = tx.judge_score(F.col("reply"))
    return b.judge_replies(spark, sf).select("task_id", score.alias("score"), status.alias("status"))


@query
def judge_prompts(spark, sf):
    template = "A developer asked: \"{reference}\"\nThe assistant answered: \"{response}\"\nReply with JSON: {\"score\": X}"
    filled = tx.judge_prompt(template, F.col("text"), limit=1500, reference=F.concat(F.lit("item "), F.col("source")))
    whole = tx.judge_prompt(template, F.col("text"), reference=F.col("source"))
    return b.table(spark, sf, "documents").select("doc_id", filled.alias("fidelity_prompt"), F.md5(whole).alias("full_prompt_md5"))


@query
def first_code_block(spark, sf):
    turns = b.table(spark, sf, "conversations")
    kind = F.col("conv_id") % 4
    response = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```Python\n"), F.col("text"), F.lit("\n```\nand\n```\nmore\n```")))
        .when(kind == 1, F.concat(F.lit("```sql\n```\n"), F.col("text")))
        .when(kind == 2, F.concat(F.lit("  "), F.col("text"), F.lit(" ```rust\nx``` \n")))
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", F.col("turn"), tx.first_code_block(response).alias("code"))


@query
def rule_check(spark, sf):
    good = b.runs(spark, sf).filter(F.col("error").isNull())
    return scoring.rule_check(good, b.rules(spark), "rule_id").select("run_id", "functional_correct")


@query
def rule_check_many(spark, sf):
    """Every document against all neighbouring words of every benchmark item; items that it holds whole in this sense."""
    words = F.split("text", " ", -1)
    items = b.table(spark, sf, "benchmark").select("item_id", words.alias("w")).where("size(w) > 1")
    rules = items.select("item_id", F.explode(F.zip_with(
        F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1),
        lambda x, y: F.concat(x, F.lit(" "), y))).alias("phrase"))
    docs = b.table(spark, sf, "documents")
    checked = patterns.rule_check_many(docs, rules, "doc_id", "text", "item_id", "phrase")
    return checked.select("doc_id", "hits", F.coalesce(_joined(F.col("passed").cast("array<string>")), F.lit("")).alias("passed"))


def _stored_scores(runs: DataFrame) -> DataFrame:
    """Stored scores: reserved but unfinished for `view`, none for `signup`."""
    return _thin_scores(runs).filter(F.col("topic") != "signup").select(
        *RUN, F.when(F.col("topic") != "view", F.col("total_tool_calls")).alias("tool_f1"))


@query
def unscored_runs(spark, sf):
    runs = b.runs(spark, sf)
    return scoring.unscored_runs(runs, _stored_scores(runs), key=RUN).select("run_id")


@query
def rescore_selection(spark, sf):
    return scoring.rescore_selection(b.runs(spark, sf), "m0").select("run_id")


def _score_table(runs: DataFrame) -> DataFrame:
    """A stored score table in its full width: finished rows, rows only reserved (`view`), none for `signup`."""
    done = F.col("topic") != "view"
    rows = runs.filter(F.col("error").isNull() & (F.col("topic") != "signup")).select(
        *RUN, F.when(done, F.col("planned_calls") / F.lit(10.0)).alias("tool_f1"),
        F.when(done, F.col("k") % 3).cast("long").alias("intent_fidelity_score"))
    return tables.evolve(rows, schemas.SCORES)


@query
def standard_scoring(spark, sf):
    runs, gold, replies = b.score_inputs(spark, sf)
    return scoring.standard_scoring(runs, _score_table(runs), gold, b.rules(spark), replies, "rule_id", RUN).drop("task_id")


@query
def rescore_tools(spark, sf):
    runs = b.runs(spark, sf)
    good = runs.filter(F.col("error").isNull()).select("run_id", "task_id", tc.tool_names(F.col("response")).alias("tool_names"))
    return scoring.rescore_tools(_score_table(runs), good, b.gold(spark, sf), RUN).select(
        "run_id", *scoring.TOOL_COLUMNS, "intent_fidelity_score")


@query
def rescore_functional(spark, sf):
    runs = b.runs(spark, sf)
    good = runs.filter(F.col("error").isNull())
    return scoring.rescore_functional(_score_table(runs), good, b.rules(spark), "rule_id", RUN).select(
        "run_id", "tool_f1", "functional_correct")


@query
def rescore_intent(spark, sf):
    runs, _, replies = b.score_inputs(spark, sf)
    return scoring.rescore_intent(_score_table(runs), replies, key=RUN).select("run_id", "tool_f1", "intent_fidelity_score")


@query
def score_summary(spark, sf):
    out = scoring.score_summary(b.runs(spark, sf), b.scored(spark, sf), RUN)
    return out.select("condition", *[F.round(c, 4).alias(c) for c in out.columns if c != "condition"])


@query
def cpstc(spark, sf):
    sums = b.scored(spark, sf).groupBy("intent", "model", "condition").agg(
        F.sum("total_tokens").alias("tokens"), F.sum("min_req_met").alias("successes"))
    return sums.withColumn("cpstc", F.round(scoring.cpstc(F.col("tokens"), F.col("successes")), 4))


@query
def token_stats(spark, sf):
    out = scoring.token_stats(b.scored(spark, sf), ["condition"], F.col("functional_correct"))
    return out.withColumn("cpstc", F.round("cpstc", 4))


# --- result tables -----------------------------------------------------------------

@query
def analysis_base(spark, sf):
    scores = b.scored(spark, sf).select(*RUN, *reports.SCORE_COLUMNS)
    joined = reports.analysis_base(b.results_frame(b.runs(spark, sf)), scores, RUN)
    return joined.select("run_id", "intent", "condition", "model", "total_tokens", "execution_time_sec", *reports.SCORE_COLUMNS)


@query
def result_cube(spark, sf):
    return reports.result_cube(b.scored(spark, sf))


@query
def bucketed_analysis(spark, sf):
    """The run log and its scores, both stored by run, joined without a shuffle and summed up."""
    runs = tables.bucketed(b.results_frame(b.runs(spark, sf)), "run_id")
    scores = tables.bucketed(b.scored(spark, sf).select("run_id", *reports.SCORE_COLUMNS), "run_id")
    return reports.analysis_base(runs, scores).groupBy("model", "condition").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.sum("total_tool_calls").alias("calls"),
        F.sum("redundant_calls").alias("redundant"), F.round(F.avg("tool_f1"), 4).alias("tool_f1"))


@query
def condition_overall(spark, sf):
    return reports.condition_overall(b.scored(spark, sf), CI_REPLICATES)


@query
def model_stratified(spark, sf):
    return reports.stratified(b.scored(spark, sf), ["model", "condition"])


@query
def model_condition_pivot(spark, sf):
    names = ["func_correct_rate", "hallucination_mean", "intent_fidelity", "tool_f1"]
    return reports.pivot_means(reports.with_flag(b.scored(spark, sf)), "model", {n: reports.OVERALL[n] for n in names})


@query
def intent_pivot(spark, sf):
    return reports.pivot_means(b.scored(spark, sf), "intent", {"tool_f1": "tool_f1"})


@query
def hallucination_deltas(spark, sf):
    return reports.hallucination_deltas(b.scored(spark, sf))


@query
def relative_lift(spark, sf):
    return reports.relative_lift(b.scored(spark, sf), "tool_f1", b.MODELS, ["intent"])


@query
def describe_metric(spark, sf):
    return inference.describe_metric(b.scored(spark, sf), ["condition"], "tool_f1")


# --- statistics --------------------------------------------------------------------

@query
def kendall_tau(spark, sf):
    names = F.filter(tc.tool_names(F.col("response")), lambda t: tc.is_valid_tool(t))
    good = b.runs(spark, sf).filter(F.col("error").isNull()).select("run_id", "task_id", names.alias("names"))
    scored = good.join(large_side(b.gold(spark, sf)), "task_id")
    return scored.select("run_id", F.round(tc.kendall_tau(F.col("names"), F.col("expected_tools")), 6).alias("tau"))


@query
def cohens_kappa(spark, sf):
    raters = b.table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return inference.cohens_kappa(raters, "quality", "clean")


@query
def document_rank_agreement(spark, sf):
    """Kendall's tau-b of the lengths of documents and their numbers of spaces."""
    docs = b.table(spark, sf, "documents").select(
        F.char_length("text").alias("chars"), (F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))
    found = rankcorr.column_kendall_tau(docs, "chars", "spaces")
    whole = [F.col(c).cast("long").alias(c) for c in ("n", "ties_x", "ties_y", "surplus")]
    return found.select(*whole, F.round("tau_b", 6).alias("tau_b"))


@query
def paired_ttest(spark, sf):
    return inference.paired_ttest(b.scored(spark, sf), ["task_id", "model"], "tool_f1")


@query
def cohens_d(spark, sf):
    return inference.cohens_d(b.scored(spark, sf), "tool_f1")


@query
def mean_ci95(spark, sf):
    return inference.mean_ci95(b.scored(spark, sf), ["model", "condition"], "tool_f1")


@query
def anova_by_intent(spark, sf):
    return inference.one_way_anova(b.scored(spark, sf), ["intent"], "condition", "tool_f1", levels=3)


@query
def anova_models(spark, sf):
    return inference.one_way_anova(b.scored(spark, sf), [], "model", "tool_f1")


@query
def anova_two_way(spark, sf):
    return inference.two_way_anova(b.scored(spark, sf), "task_id", "condition", "model", "tool_f1", CONDITIONS, b.MODELS)


@query
def tukey_q(spark, sf):
    return inference.tukey_q(b.scored(spark, sf), "model", "tool_f1")


@query
def tukey_hsd(spark, sf):
    return inference.tukey_hsd(b.scored(spark, sf), ["condition"], "model", "tool_f1")


@query
def mcnemar_exact(spark, sf):
    return inference.mcnemar_exact(b.scored(spark, sf), ["task_id", "model"], "min_req_met")


@query
def mcnemar_hallucination(spark, sf):
    flagged = b.scored(spark, sf).withColumn("clean", (F.col("hallucination_score") == 0).cast("int"))
    return inference.mcnemar_exact(flagged, ["task_id", "model"], "clean", "b", "c")


@query
def failure_taxonomy(spark, sf):
    base = b.with_calls(b.runs(spark, sf))
    named = base.withColumn("tool_names", scoring.called_names(F.col("tool_calls"))).withColumn(
        "invalid_calls", F.size(F.filter("tool_calls", lambda c: ~c["valid"])))
    checked = scoring.with_sequence_scores(named.join(large_side(scoring.with_candidates(b.gold(spark, sf))), "task_id"))
    return reports.failure_taxonomy(checked, ["condition"])


# --- resampling --------------------------------------------------------------------

BOUNDS = ["ci_lower", "ci_upper"]


@query
def bootstrap_cpstc(spark, sf):
    return resample.rounded(resample.multinomial_ratio(
        b.scored(spark, sf), ["condition"], "total_tokens", "min_req_met", replicates=1000), BOUNDS)


@query
def bootstrap_cpstc_cover(spark, sf):
    """Runs, cost per success and whether the n-of-n interval covers it."""
    scored = b.scored(spark, sf).select("condition", "total_tokens", "min_req_met")
    whole = scored.groupBy("condition").agg(
        F.count("*").alias("n"), scoring.cpstc(F.sum("total_tokens"), F.sum("min_req_met")).alias("ratio"))
    bounds = resample.multinomial_ratio(scored, ["condition"], "total_tokens", "min_req_met", replicates=1000)
    inside = F.col("ratio").between(F.col("ci_lower"), F.col("ci_upper"))
    close = (F.col("ci_upper") - F.col("ci_lower")) < F.col("ratio")
    return whole.join(bounds, "condition").select("condition", "n", F.round("ratio", 4).alias("ratio"), (inside & close).alias("covered"))


@query
def bootstrap_poisson(spark, sf):
    out = resample.poisson_ratio(b.scored(spark, sf), ["condition"], "total_tokens", "min_req_met", CI_REPLICATES)
    return resample.rounded(out, BOUNDS).select("condition", *BOUNDS)


@query
def bootstrap_mean(spark, sf):
    out = resample.poisson_mean(b.scored(spark, sf), ["model", "condition"], "tool_f1", CI_REPLICATES)
    return resample.rounded(out, BOUNDS).select("model", "condition", *BOUNDS)


# --- chart datasets ----------------------------------------------------------------

@query
def fig_mean_ci(spark, sf):
    scored = b.scored(spark, sf)
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in ("intent_fidelity_score", "tool_f1", "kendall_tau")])
    long = scored.select("condition", F.explode_outer(metrics).alias("m")).select("condition", "m.*")
    return resample.mean_with_interval(long.filter(F.col("value").isNotNull()), ["metric", "condition"], "value", CI_REPLICATES)


@query
def fig_precision_recall(spark, sf):
    return reports.long_means(b.scored(spark, sf), ["condition"], {"precision": "tool_precision", "recall": "tool_recall"})


@query
def fig_model_f1(spark, sf):
    return resample.mean_with_interval(b.scored(spark, sf), ["model", "condition"], "tool_f1", CI_REPLICATES)


@query
def fig_intent_f1(spark, sf):
    return reports.long_means(b.scored(spark, sf), ["intent", "condition"], {"mean_f1": "tool_f1"})


@query
def fig_token_scatter(spark, sf):
    return reports.token_scatter(b.scored(spark, sf))


@query
def fig_redundancy_success(spark, sf):
    return reports.long_means(b.scored(spark, sf), ["condition"], {"redundant": "redundant_calls", "success": "min_req_met"})


@query
def fig_hallucination(spark, sf):
    return reports.pivot_means(b.scored(spark, sf), "model", {"hallucination": "hallucination_score"})


@query
def fig_pareto(spark, sf):
    return reports.pareto(b.scored(spark, sf), CI_REPLICATES)


@query
def run_frontier(spark, sf):
    """Runs that no cheaper run of their intent matches in F1."""
    points = b.scored(spark, sf).select("run_id", "intent", "total_tokens", F.round("tool_f1", 4).alias("f1"))
    return frontier.frontier(points, ["intent"], "total_tokens", "f1")


@query
def fig_latency(spark, sf):
    return resample.mean_with_interval(b.scored(spark, sf), ["model", "condition"], "execution_time_sec", CI_REPLICATES)


@query
def fig_success(spark, sf):
    return reports.long_means(b.scored(spark, sf), ["condition"], {"first_call": "first_call_correct", "eventual": "min_req_met"})


@query
def fig_fidelity_model(spark, sf):
    return resample.mean_with_interval(b.scored(spark, sf), ["model", "condition"], "intent_fidelity_score", CI_REPLICATES)


@query
def fig_tokens(spark, sf):
    return reports.long_means(b.scored(spark, sf), ["condition"], {"input": "input_tokens", "output": "output_tokens"})


@query
def fig_compliance(spark, sf):
    return resample.mean_with_interval(b.scored(spark, sf), ["model", "condition"], "format_compliance", CI_REPLICATES)


# --- incremental -------------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    return incremental.file_stream(spark, sf, "events.parquet", b.table(spark, sf, "events").schema)


@query
def stream_scoring(spark, sf):
    """Events arrive, become runs, are scored per batch and read back as the current table."""
    folder, n = _folder(spark, "scores"), shares(b.table(spark, sf, "events"))

    def score(events: DataFrame) -> DataFrame:
        return b.scored_in_place(spark, b.runs_of(b.tasks_of(b.deal_events(events, n)))).select(
            "run_id", "condition", "tool_f1", "min_req_met", "total_tokens")

    incremental.score_stream(_event_stream(spark, sf), score, f"{folder}/out", f"{folder}/state")
    return incremental.read_scores(spark, f"{folder}/out", ["run_id"], ["batch"]).drop("batch")


@query
def stream_summary(spark, sf):
    folder = _folder(spark, "summary")
    """Score averages per condition, kept up while events arrive."""
    scores = b.scored_in_place(spark, b.runs_of(b.tasks_of(_event_stream(spark, sf))))
    averages = {"avg_intent_fidelity": "intent_fidelity_score", "avg_f1": "tool_f1",
                "avg_hallucination": "hallucination_score", "avg_tokens": "total_tokens"}
    aggregates = [F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in averages.items()]]
    incremental.running_summary(scores, ["condition"], aggregates, f"{folder}/out", f"{folder}/state")
    return incremental.read_summary(spark, f"{folder}/out").select(
        "condition", "n", *[F.round(name, 4).alias(name) for name in averages])


@query
def stream_last_attempt(spark, sf):
    """Attempts arrive in three files, with replays, retries and late older ones; sums of the last attempt of every run."""
    folder = _folder(spark, "attempts")
    runs = b.runs(spark, sf)
    third = F.pmod(F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("run_id")), 1, 1)), F.lit(3))
    # Five parts of three files come from these rows, so they are derived once and stored.
    first = cut_lineage(runs.select("run_id", "model", "condition", "total_tokens", F.col("error").isNotNull().cast("long").alias("failed"),
                                    third.alias("third"), F.lit(1).alias("version")))
    retried = lambda df, version, more: df.withColumns({
        "version": F.lit(version), "total_tokens": F.col("total_tokens") + more, "failed": F.lit(0).cast("long")})
    files = [
        first.where("third < 2"),
        first.where("third > 0").unionByName(retried(first.where("third = 0"), 2, 10)),
        retried(first.where("third = 0"), 0, 1000).unionByName(retried(first.where("third = 2 AND failed = 1"), 3, 5)),
    ]
    measures = ["total_tokens", "failed"]
    for arrived in files:
        arrived.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        changes = attempts.attempt_changes(stream, "run_id", "version", ["model", "condition"], measures)
        attempts.store_changes(changes, ["model", "condition"], measures, f"{folder}/out", f"{folder}/state")
    forget(first)
    return attempts.read_sums(spark, f"{folder}/out", ["model", "condition"], measures)


# --- counts of row-level results ---------------------------------------------------

# query: (scores as ten-thousandths, further columns)
COUNTED = {
    "best_sequence_f1": (["tool_precision", "tool_recall", "tool_f1"], ["total_tool_calls", "redundant_calls"]),
    "standard_scoring": (["intent_preservation", "tool_precision", "tool_recall", "tool_f1"],
                         ["total_tool_calls", "redundant_calls", "first_call_correct", "min_req_met", "hallucination_score",
                          "intent_fidelity_score", "functional_correct"]),
    "rescore_tools": (["tool_precision", "tool_recall", "tool_f1"],
                      ["total_tool_calls", "redundant_calls", "first_call_correct", "min_req_met", "intent_fidelity_score"]),
    "rescore_functional": (["tool_f1"], ["functional_correct"]),
    "rescore_intent": (["tool_f1"], ["intent_fidelity_score"]),
    "analysis_base": (["tool_precision", "tool_recall", "tool_f1"],
                      ["intent", "condition", "model", "total_tool_calls", "redundant_calls", "first_call_correct", "min_req_met",
                       "hallucination_score", "intent_fidelity_score", "functional_correct"]),
    "fig_token_scatter": (["tool_f1"], ["condition", "total_tokens"]),
    "stream_scoring": (["tool_f1"], ["condition", "min_req_met"]),
}


def _counts_of(name: str) -> Query:
    def counts(spark, sf):
        """Rows per distinct result: all rows of a row-level query in a few lines."""
        scores, further = COUNTED[name]
        tuples = [F.round(F.col(c) * 10000).cast("long").alias(c) for c in scores] + [F.col(c) for c in further]
        return REGISTRY[name](spark, sf).groupBy(*tuples).agg(F.count("*").alias("n"))

    return counts


REGISTRY.update({f"{name}_counts": _counts_of(name) for name in COUNTED})
