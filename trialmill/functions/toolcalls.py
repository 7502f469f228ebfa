"""Tool calls declared in response text, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import VALID_TOOLS
from .arrays import let
from .text import strip

# (?U): names may hold any Unicode word character.  The letters are spelled out, since no other character folds to
# one of them and (?i) would fold every character of the text.  Nothing that a part takes can begin the next one, so no
# part gives characters back.
CALL_PATTERN = r"(?U)[Tt][Oo][Oo][Ll]_[Cc][Aa][Ll][Ll]:\s*+(\w++)\s*+\(([^)]*+)\)"
#: Name, spaces, bracket and parameters as one group: one pass finds both.
_WHOLE_CALL = CALL_PATTERN.replace(r"(\w++)\s*+\(([^)]*+)\)", r"(\w++\s*+\([^)]*+)\)")
CALL_SCHEMA = "array<struct<tool:string, params:string, valid:boolean>>"


def tool_names(text: Column) -> Column:
    """All declared names in order, lower-cased, valid or not."""
    return F.transform(F.regexp_extract_all(text, F.lit(CALL_PATTERN), F.lit(1)), F.lower)


def is_valid_tool(name: Column, tools: list[str] = VALID_TOOLS) -> Column:
    return name.isin(tools)


def extract_tool_calls(text: Column, tools: list[str] = VALID_TOOLS) -> Column:
    def parts(call: Column) -> Column:
        name = F.lower(strip(F.substring_index(call, "(", 1)))
        params = strip(call.substr(F.instr(call, F.lit("(")) + 1, F.length(call)))
        return F.struct(name.alias("tool"), params.alias("params"), is_valid_tool(name, tools).alias("valid"))

    return F.transform(F.regexp_extract_all(text, F.lit(_WHOLE_CALL), F.lit(1)), parts)


def explode_calls(df: DataFrame, keys: list[str], calls: str = "tool_calls") -> DataFrame:
    """One row per call.  The outer form with a filter after it: an inner explode makes
    Catalyst add a size check below, which would extract the calls a second time."""
    each = df.select(*keys, F.posexplode_outer(calls).alias("pos", "_call")).filter(F.col("pos").isNotNull())
    return each.select(*keys, "pos", "_call.tool", "_call.params", "_call.valid")


def valid_calls(calls: Column) -> Column:
    return F.filter(calls, lambda c: c["valid"])


def valid_names(calls: Column) -> Column:
    return F.transform(valid_calls(calls), lambda c: c["tool"])


def call_validation(calls: Column) -> Column:
    invalid = F.filter(calls, lambda c: ~c["valid"])
    return F.struct(
        F.size(calls).cast("long").alias("total_calls"),
        F.size(valid_calls(calls)).cast("long").alias("valid_calls"),
        F.size(invalid).cast("long").alias("invalid_calls"),
        F.transform(invalid, lambda c: c["tool"]).alias("invalid_tool_names"),
        (F.size(calls) > 0).alias("has_any_tool_call"),
        valid_names(calls).alias("tool_sequence"),
    )


def redundant_calls(names: Column) -> Column:
    return (F.size(names) - F.size(F.array_distinct(names))).cast("long")


def tool_halluc_rate(calls_json: Column) -> Column:
    """Share of calls marked invalid in stored JSON; a call without the mark is valid."""
    calls = F.from_json(calls_json, "array<struct<tool:string, valid:boolean>>")
    bad = F.filter(calls, lambda c: ~F.coalesce(c["valid"], F.lit(True)))
    return F.coalesce(F.try_divide(F.size(bad).cast("double"), F.size(calls)), F.lit(0.0))


def format_compliance(total_calls: Column) -> Column:
    return (total_calls > 0).cast("double")


def kendall_tau(names: Column, expected: Column) -> Column:
    """Order agreement of a call sequence with the expected order (tau-b).

    Ranks are compared with their own sorted copy, so both sides share their ties and the
    denominator is pairs minus tied pairs.  Fewer than two calls give NULL, all tied 0.
    """
    def rank(tool: Column) -> Column:
        from_end = F.array_position(F.reverse(expected), tool)
        return F.when(from_end > 0, F.size(expected) - from_end).otherwise(F.size(expected)).cast("int")

    return let(names, lambda seq: F.when(F.size(seq) >= 2, tau_of_ranks(F.transform(seq, rank))))


def tau_of_ranks(ranks: Column) -> Column:
    def pairs(x: Column, y: Column) -> Column:
        def step(acc: Column, i: Column, j: Column) -> Column:
            apart = (F.get(y, j) > F.get(y, i)).cast("int")
            move = F.sign(F.get(x, j) - F.get(x, i)).cast("int")
            return F.struct((acc["s"] + apart * move).alias("s"), (acc["n"] + apart).alias("n"))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(x) - 1),
            F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")),
            lambda acc, j: F.aggregate(F.sequence(F.lit(0), j - 1), acc, lambda a, i: step(a, i, j)),
            lambda acc: F.coalesce(F.try_divide(acc["s"].cast("double"), acc["n"]), F.lit(0.0)),
        )

    return let(ranks, lambda x: let(F.array_sort(x), lambda y: pairs(x, y)))
