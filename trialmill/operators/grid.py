"""Run grid, resume, and the batch run stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import CONDITIONS, ERROR_TEXT_LIMIT
from ..functions.text import count_tokens
from ..functions.toolcalls import extract_tool_calls, valid_names
from ..session import large_side
from .tables import key_columns


def run_id(task: Column, condition: Column, model: Column) -> Column:
    return F.concat(task, F.lit("_cond"), condition, F.lit("_"), model)


def run_grid(tasks: DataFrame, models: list[str], conditions: list[str] = CONDITIONS) -> DataFrame:
    """Every task under every model and condition.  The axes are literal arrays, so the
    grid is generated inside each task partition without a join."""
    return (
        tasks
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
        .withColumn("run_id", run_id(F.col("task_id"), F.col("condition"), F.col("model")))
    )


def pilot_grid(tasks: DataFrame, model: str, order: str, n_tasks: int = 5) -> DataFrame:
    return run_grid(tasks.orderBy(order).limit(n_tasks), [model])


def pending_runs(grid: DataFrame, done: DataFrame, key: str | list[str] = "run_id") -> DataFrame:
    """Runs not finished yet; a run that ended in an error is due again."""
    keys = key_columns(key)
    return grid.join(large_side(done.filter(F.col("error").isNull()).select(*keys)), keys, "left_anti")


RUN_STAGE_COLUMNS = ("response string, usage_input long, usage_output long, execution_time_sec double, error string, "
                     "timestamp timestamp")


def run_stage(prompts: DataFrame, responder: Callable[[str], dict], timer: Callable[[], float] | None = None) -> DataFrame:
    """Call `responder` once per prompt: one row out per row in, an error row on failure.

    `responder(prompt)` returns `response` and optionally `input_tokens`, `output_tokens`; `timestamp` is when
    the call ended.
    It is the caller's code, hence the only Python in the run path.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", " + RUN_STAGE_COLUMNS
    limit = ERROR_TEXT_LIMIT

    def call(prompt: str) -> tuple:
        started = timer() if timer else 0.0
        try:
            reply = responder(prompt)
            out = (reply["response"], reply.get("input_tokens"), reply.get("output_tokens"))
            error = None
        except Exception as failure:
            out, error = (None, 0, 0), str(failure)[:limit]
        took = round(timer() - started, 3) if timer else 0.0
        return (*out, took, error, pd.Timestamp.now(tz="UTC"))

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["response", "usage_input", "usage_output", "execution_time_sec", "error", "timestamp"]
        for batch in batches:
            replies = pd.DataFrame([call(p) for p in batch["prompt"]], columns=names, index=batch.index)
            replies = replies.astype({"usage_input": "Int64", "usage_output": "Int64", "timestamp": "datetime64[ns, UTC]"})
            yield pd.concat([batch, replies], axis=1)

    return prompts.mapInPandas(stage, schema)


def finish_runs(raw: DataFrame) -> DataFrame:
    """Run-log columns from stage output: calls, tokens with fallback, zeroes on errors."""
    failed = F.col("error").isNotNull()
    calls = F.when(failed, F.array().cast("array<struct<tool:string, params:string, valid:boolean>>")).otherwise(
        extract_tool_calls(F.col("response")))
    sent = F.when(failed, 0).otherwise(F.coalesce("usage_input", count_tokens(F.col("prompt"))))
    got = F.when(failed, 0).otherwise(F.coalesce("usage_output", count_tokens(F.col("response"))))
    return (
        raw.withColumns({"tool_calls": calls, "input_tokens": sent.cast("long"), "output_tokens": got.cast("long")})
        .withColumns({
            "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
            "tool_calls_json": F.to_json("tool_calls"),
            "tool_sequence": F.to_json(valid_names(F.col("tool_calls"))),
            "total_tool_calls": F.size("tool_calls").cast("long"),
            "execution_time_sec": F.round("execution_time_sec", 3),
        })
        .drop("usage_input", "usage_output")
    )


def error_text(message: Column) -> Column:
    return F.substring(message, 1, ERROR_TEXT_LIMIT)


def run_status(runs: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.col("error").isNotNull()
    return runs.groupBy(*keys).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
