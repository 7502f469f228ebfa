"""Views of a prompt experiment over the given parquet tables.

The tables hold no prompts or tool calls, so each view derives its columns row by row
from a whole table.  No view samples, cuts or groups its source; a hot user or source
never ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..fixed_values import CASE, COMPOSITE_INTENT, CONDITIONS, RULES, SAMPLED_INTENTS
from ..functions import toolcalls
from ..functions.text import zero_padded
from ..operators import scoring
from ..session import fan_out, inline_table, settle, shares

INTENTS = SAMPLED_INTENTS + [COMPOSITE_INTENT]
MODELS = ["m0", "m1", "m2"]
HEX = "0123456789abcdef"
TOOL_MENU = [
    "read_file", "write_file", "search_codebase", "run_tests", "read_file", "write_file", "fetch_docs", "git_diff",
    "lint_code", "execute_shell", "read_file", "write_file", "run_tests", "search_codebase", "made_up_tool", "deploy_app",
]
CODE_MENU = [
    "retry", "except", "null", "if user", "react", "dropdown", "jwt token", "config",
    "test", "payment", "async", "await", "try", "login 401", "class", "import",
]
GOLD_MENU = [
    (
        ["search_codebase", "read_file", "write_file", "run_tests"],
        ["search_codebase", "read_file", "write_file"],
        [["read_file", "search_codebase", "write_file", "run_tests"],
         ["search_codebase", "read_file", "write_file"], ["read_file", "write_file", "run_tests"]],
    ),
    (["fetch_docs", "write_file"], ["write_file"], [["write_file"], ["fetch_docs", "write_file", "lint_code"]]),
    (["read_file", "write_file", "lint_code", "git_diff"], ["read_file", "write_file"], [["read_file", "write_file"]]),
    (["execute_shell", "write_file", "fetch_docs"], ["execute_shell", "write_file"], []),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literals(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _digit(hexed: Column, at: Column | int) -> Column:
    """Value 1..16 of one hex digit."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.instr(F.lit(HEX), hexed.substr(place, F.lit(1)))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per event, dealt by task.

    A row group is read by one task however many splits the scan has, and an event becomes nine runs, so the
    slim events are dealt out first.  What derives from them keeps this order: frames with `task_id` join on it, and on
    `task_id` with further keys, without another shuffle (Spark has to be told that a part of the keys is enough).
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    events = table(spark, sf_dir, "events")
    return tasks_of(deal_events(events, shares(events)))


def deal_events(events: DataFrame, n: int) -> DataFrame:
    return events.withColumn("task_id", _task_id()).repartition(n, "task_id")


def _task_id() -> Column:
    return F.concat(F.lit("task_"), zero_padded(F.col("event_id"), 12))


def tasks_of(events: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return events.select(
        F.col("task_id") if "task_id" in events.columns else _task_id().alias("task_id"),
        F.col("event_id").alias("task_no"),
        F.element_at(_literals(INTENTS), (user % 8 + 1).cast("int")).alias("intent"),
        user.alias("owner"),
        (user % 4).cast("int").alias("gold_no"),
        F.when(user % 2 == 0, F.element_at(_literals(list(RULES)), (F.floor(user / 2) % len(RULES) + 1).cast("int")))
        .alias("rule_id"),
        F.col("event_type").alias("topic"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold standards; tasks of owners with `owner % 50 = 7` have none."""
    base = tasks(spark, sf_dir).filter(F.col("owner") % 50 != 7)
    return base.select("task_id", *gold_columns(F.col("gold_no")), F.col("rule_id").isNotNull().alias("has_unit_test"))


def gold_columns(gold_no: Column) -> list[Column]:
    empty = F.array().cast("array<array<string>>")
    menus = {
        "expected_tools": F.array(*[_literals(g[0]) for g in GOLD_MENU]),
        "minimum_required_tools": F.array(*[_literals(g[1]) for g in GOLD_MENU]),
        "alternative_tool_sequences": F.array(*[
            F.array(*[_literals(s) for s in g[2]]) if g[2] else empty for g in GOLD_MENU]),
    }
    return [F.element_at(menu, gold_no + 1).alias(name) for name, menu in menus.items()]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: every task under every condition and model."""
    return runs_of(tasks(spark, sf_dir))


def runs_of(task_frame: DataFrame) -> DataFrame:
    grid = (
        task_frame
        .withColumn("model", F.explode(_literals(MODELS)))
        .withColumn("condition", F.explode(_literals(CONDITIONS)))
        .withColumn("hexed", F.md5(F.concat_ws("-", F.col("task_no").cast("string"), "condition", "model")))
    )
    h, k = F.col("hexed"), F.col("k")
    failed = (F.col("owner") % 50 == 9) & (F.col("condition") == "b") & (F.col("model") == "m0")
    bonus = F.when(F.col("condition") == "c", 1).otherwise(0)
    n_calls = F.coalesce((_digit(h, 1) - 1) % 6 + bonus, F.lit(0))
    marker = F.when(_digit(h, 15) <= 4, F.lit("tool_call:")).otherwise(F.lit("TOOL_CALL: "))

    # Neither lambdas, which run uncompiled, nor anything that can be NULL: what only asks whether there is a response
    # then needs no text.
    topic, item = F.coalesce("topic", F.lit("")), F.coalesce(k.cast("string"), F.lit(""))

    def line(i: int) -> Column:
        name = F.element_at(_literals([t.upper() for t in TOOL_MENU] if i == 2 else TOOL_MENU), _digit(h, i + 1))
        return F.when(n_calls >= i, F.concat(marker, name, F.lit("( path=\"src/item_"), item, F.lit(".py\" )")))

    calls = F.concat_ws("\n", *[line(i) for i in range(1, 7)])
    words = F.concat_ws(" ", *[F.element_at(_literals(CODE_MENU), _digit(h, i)) for i in range(17, 22)])
    fence = F.when(_digit(h, 14) <= 2, F.lit("")).otherwise(F.lit("```"))
    lang = F.when(_digit(h, 14) <= 2, F.lit("")).otherwise(F.lit("python"))
    text = F.concat(
        F.lit("Notes on "), topic, F.lit(" "), item, F.lit(".\n"), calls,
        F.lit("\nTOOL_CALL: git_diff\n"), fence, lang, F.lit("\n"), words, F.lit("\n"), fence, F.lit("\nDone."),
    )
    cond_no = F.instr(F.lit("abc"), F.col("condition"))
    sent = F.when(failed, 0).otherwise(180 + k + cond_no * 12).cast("long")
    staged = grid.select(
        F.concat("task_id", F.lit("_cond"), "condition", F.lit("_"), "model").alias("run_id"),
        "task_id", "task_no", "intent", "condition", "model", "owner", "gold_no", "rule_id", "topic", "cents", "k",
        n_calls.cast("long").alias("planned_calls"),
        F.when(~failed & F.col("topic").isNotNull() & k.isNotNull(), text).alias("response"),
        sent.alias("input_tokens"),
        ((500 + (F.col("cents") * 7 + _digit(h, 16) * 31) % 4000) / 1000.0).cast("double").alias("execution_time_sec"),
        F.when(failed, F.concat(F.lit("timeout after 60s on "), "topic")).alias("error"),
    )
    got = F.coalesce(F.length("response") + F.col("planned_calls") * 9, F.lit(0)).cast("long")
    return staged.withColumn("output_tokens", got).withColumn(
        "total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def with_calls(run_frame: DataFrame) -> DataFrame:
    empty = F.array().cast(toolcalls.CALL_SCHEMA)
    calls = F.coalesce(toolcalls.extract_tool_calls(F.col("response")), empty)
    return settle(settle(run_frame, "response").withColumn("tool_calls", calls), "tool_calls")


def rules(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("rule_id", T.StringType()), T.StructField("clause", T.IntegerType()),
        T.StructField("ignore_case", T.BooleanType()), T.StructField("any_of", T.ArrayType(T.StringType())),
    ])
    rows = [
        (rule, i, clause[0] != CASE, [w for w in clause if w != CASE])
        for rule, clauses in RULES.items() for i, clause in enumerate(clauses)
    ]
    return inline_table(spark, schema, rows)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored runs: tool metrics, judge scores and rule checks of every good run with gold."""
    return scored_of(spark, runs(spark, sf_dir), gold(spark, sf_dir))


def scored_of(spark: SparkSession, run_frame: DataFrame, gold_frame: DataFrame) -> DataFrame:
    return _judged(scoring.score_tools(_checked(spark, run_frame), gold_frame))


def scored_in_place(spark: SparkSession, run_frame: DataFrame) -> DataFrame:
    """As `scored_of`, with the gold standard derived in the row itself: no join with a gold table, so a
    stream reads nothing beside its own batch."""
    checked = _checked(spark, run_frame.filter(F.col("owner") % 50 != 7))
    return _judged(scoring.with_sequence_scores(checked.select("*", *gold_columns(F.col("gold_no")))))


def _checked(spark: SparkSession, run_frame: DataFrame) -> DataFrame:
    good = settle(run_frame.filter(F.col("error").isNull()), "response")
    good = settle(good.withColumn("tool_names", toolcalls.tool_names(F.col("response"))), "tool_names")
    return scoring.rule_check(good, rules(spark), "rule_id").drop("response")


def score_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs with response vectors, gold with reference vectors, and two judge replies a run."""
    run_frame = runs(spark, sf_dir)
    vector = F.array(*[c.cast("double") for c in (F.col("planned_calls") + 1, F.col("k") % 7, F.lit(2))])
    reference = F.array(*[c.cast("double") for c in (F.col("k") % 5, F.lit(1), F.col("owner") % 3)])
    base = tasks(spark, sf_dir).filter(F.col("owner") % 50 != 7)
    gold_frame = base.select("task_id", *gold_columns(F.col("gold_no")), reference.alias("gold_embedding"))
    fidelity = F.when(F.col("topic") == "error", F.lit("no verdict")).otherwise(
        F.concat(F.lit('Verdict: {"score": "'), (F.col("k") % 4).cast("string"), F.lit('"}')))
    replies = run_frame.filter(F.col("error").isNull()).select(
        "task_id", "run_id",
        F.concat(F.lit('{"score": '), (F.col("planned_calls") % 3).cast("string"), F.lit("}")).alias("hallucination_reply"),
        fidelity.alias("fidelity_reply"))
    return run_frame.withColumn("embedding", vector), gold_frame, replies


def _judged(measured: DataFrame) -> DataFrame:
    measured = measured.withColumn("valid_names", F.filter("tool_names", lambda t: toolcalls.is_valid_tool(t)))
    invalid = F.size("tool_names") - F.size("valid_names")
    return measured.withColumns({
        "hallucination_score": F.least(F.lit(2), invalid).cast("long"),
        "intent_fidelity_score": ((F.col("owner") + F.col("total_tool_calls")) % 4).cast("long"),
        "tool_halluc_rate": F.coalesce(F.try_divide(invalid.cast("double"), F.size("tool_names")), F.lit(0.0)),
        "format_compliance": toolcalls.format_compliance(F.col("total_tool_calls")),
        "kendall_tau": toolcalls.kendall_tau(F.col("valid_names"), F.col("expected_tools")),
    })


def results_frame(run_frame: DataFrame) -> DataFrame:
    return run_frame.select("run_id", "task_id", "intent", "condition", "model", "input_tokens", "output_tokens",
                            "total_tokens", "execution_time_sec", "error")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken-style prompts: whole documents with fillers and contractions spliced in."""
    docs = fan_out(table(spark, sf_dir, "documents"), "doc_id")
    kind = F.col("doc_id") % 4
    spoken = (
        F.when(kind == 0, F.replace("text", F.lit(". "), F.lit(". Um, you know what I mean,  it's ")))
        .when(kind == 1, F.replace("text", F.lit(", "), F.lit(" kind of. I'm   sure they're ")))
        .when(kind == 2, F.concat(F.lit("Okay so "), F.replace("text", F.lit(". "), F.lit(" Hmm, like, DON'T and let's. "))))
        .otherwise(F.col("text"))
    )
    return docs.select(
        "doc_id", F.element_at(_literals(INTENTS), (F.col("doc_id") % 8 + 1).cast("int")).alias("intent"),
        spoken.alias("utterance"), F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("  "))
        .otherwise(F.col("source")).alias("framework"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("nan")).when(F.col("doc_id") % 5 == 1, F.lit("key error")).alias("error_type"),
        "source", "n_chars",
    )


def structured_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a structuring model: good, fenced, broken, with trailing text, or failed."""
    base = tasks(spark, sf_dir)
    raw = F.concat(F.lit("please handle "), F.col("topic"), F.lit(" number "), F.col("k").cast("string"))
    good = F.concat(
        F.lit('{"raw_utterance": "'), raw, F.lit('", "normalized": "handle '), F.col("topic"), F.lit('", "intent": "'),
        F.col("intent"), F.lit('", "confidence_score": 0.'), zero_padded(F.col("k"), 2),
        F.lit(', "entities": {"error_type": null, "component": "'), F.col("topic"),
        F.lit('", "language": "sql", "framework": null}}'))
    reply = (
        F.when(F.col("topic") == "click", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(F.col("topic") == "error", F.concat(F.lit("Sure! "), good))
        .when(F.col("topic") == "view", F.concat(good, F.lit(" extra words")))
        .when(F.col("topic") == "purchase", good)
    )
    return base.select("task_id", "intent", raw.alias("raw"), reply.alias("reply"),
                       F.when(F.col("topic") == "signup", F.lit("rate limit")).alias("api_error"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tasks(spark, sf_dir)
    k = F.col("k").cast("string")
    variant = F.col("owner") % 12
    reply = (
        F.when(variant == 0, F.concat(F.lit('{"score": '), k, F.lit(', "reasoning": "fine"}')))
        .when(variant == 1, F.concat(F.lit('Verdict:\n{"score": '), k, F.lit('.7, "claims": [{"x": 1}]}\nDone.')))
        .when(variant == 2, F.concat(F.lit('{"score": "'), k, F.lit('"}')))
        .when(variant == 3, F.concat(F.lit('{"score": '), k, F.lit(', }')))
        .when(variant == 4, F.lit("I cannot judge this."))
        .when(variant == 5, F.lit(None))
        .when(variant == 6, F.concat(F.lit('{"reasoning": "'), F.col("topic"), F.lit('"}')))
        .when(variant == 7, F.concat(F.lit('{"score": "'), k, F.lit('.5"}')))
        .when(variant == 8, F.concat(F.lit('{"score": '), k, F.lit('} and {"score": 1}')))
        .when(variant == 9, F.lit('{"score": true}'))
        .when(variant == 10, F.concat(F.lit('{"score": 1, "why": "a", "score": '), k, F.lit("}")))
        .otherwise(F.lit('{"score": null}'))
    )
    return base.select("task_id", "topic", reply.alias("reply"))


def vectors_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = fan_out(table(spark, sf_dir, "embeddings"), "vec_id")
    return emb.select("vec_id", F.col("label").cast("int").alias("label"),
                      F.col("embedding").cast("array<double>").alias("vec"),
                      (F.col("vec_id") % 6).cast("int").alias("cluster"),
                      (F.col("vec_id") % 4).cast("long").alias("entity_count"))
