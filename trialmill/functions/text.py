"""Prompt-text columns: cleaning, structured-prompt parsing, prompt rendering."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, functions as F

from .arrays import let
from ..fixed_values import CONTRACTIONS, FENCE_LANGUAGES, FILLERS, PLAIN_LABEL, STRUCTURED_LABEL

# Whitespace as Unicode text handling sees it, plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
_TRIM_CHARS = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_TRIM_CHARS))


def zero_padded(number: Column, width: int) -> Column:
    """The number with zeros in front up to `width` digits; a longer one stays whole."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def _contraction_rules() -> list[tuple[str, str, str]]:
    """(ending, pattern, replacement) rows: one pass per shared ending instead of one per word.

    Words such as "they're" and "we're" keep their stem and swap the ending, so a single
    pattern with a back-reference serves them all.
    """
    def split(word: str, expansion: str) -> tuple[str, str, str]:
        cut = len(word) - 3 if word.endswith("n't") else word.index("'")
        stem, ending = word[:cut], word[cut:]
        if expansion.startswith(stem + " "):
            return ending, expansion[len(stem):], stem
        return word, expansion, ""

    parts = sorted((split(w, e) for w, e in CONTRACTIONS.items()), key=lambda p: p[:2])
    rules = []
    for (ending, replacement), members in groupby(parts, key=lambda p: p[:2]):
        stems = [m[2] for m in members]
        if stems == [""]:
            rules.append((ending, rf"(?U)\b{ending}\b", replacement))
        else:
            rules.append((ending, rf"(?U)\b({'|'.join(stems)}){ending}\b", "$1" + replacement))
    return rules


def expand_contractions(text: Column) -> Column:
    """Expand contractions in lower-cased text.  Text without an ending skips its pass, text without an
    apostrophe all of them."""
    def swap(ending: str, pattern: str, replacement: str):
        return lambda t: F.when(F.contains(t, F.lit(ending)), F.regexp_replace(t, pattern, replacement)).otherwise(t)

    expanded = text
    for rule in _contraction_rules():
        expanded = let(expanded, swap(*rule))
    return F.when(F.contains(text, F.lit("'")), expanded).otherwise(text)


def strip_fillers(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?iU)\b({'|'.join(FILLERS)})\b", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def capitalise_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def end_with_stop(text: Column) -> Column:
    open_ended = (text != "") & ~F.right(text, F.lit(1)).isin(".", "!", "?")
    return F.when(open_ended, F.concat(text, F.lit("."))).otherwise(text)


def clean_text(raw: Column) -> Column:
    """The cleaned prompt variant, in the order the steps depend on each other."""
    spoken = strip_fillers(expand_contractions(F.lower(raw)))
    return end_with_stop(capitalise_first(collapse_spaces(spoken)))


STRUCTURED_SCHEMA = (
    "raw_utterance string, normalized string, intent string, confidence_score double, "
    "entities struct<error_type:string, component:string, language:string, framework:string>"
)


def unfence_json(reply: Column) -> Column:
    bare = F.replace(F.replace(strip(reply), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return strip(bare)


def parse_structured_prompt(reply: Column, raw: Column, api_error: Column | None = None) -> Column:
    """Structured prompt record; a reply that is no JSON object falls back to the raw text.

    The reply is parsed as the only element of an array, so trailing text is an error
    instead of being ignored.
    """
    wrapped = F.concat(F.lit("["), unfence_json(reply), F.lit("]"))
    parsed = F.from_json(wrapped, f"array<struct<{_as_struct(STRUCTURED_SCHEMA)}>>", {"allowSingleQuotes": "false"})
    record = F.get(parsed, F.lit(0))
    good = (F.size(parsed) == 1) & record.isNotNull() & F.startswith(unfence_json(reply), F.lit("{"))
    null = F.lit(None).cast("string")
    api = F.lit(None).cast("string") if api_error is None else api_error
    fallback = F.struct(
        raw.alias("raw_utterance"),
        raw.alias("normalized"),
        F.lit("unknown").alias("intent"),
        F.lit(0.0).alias("confidence_score"),
        F.struct(*[null.alias(n) for n in ("error_type", "component", "language", "framework")]).alias("entities"),
        F.when(api.isNull(), F.lit("malformed JSON")).alias("_parse_error"),
        api.alias("_api_error"),
    )
    names = ("raw_utterance", "normalized", "intent", "confidence_score", "entities")
    kept = F.struct(*[record[n].alias(n) for n in names], null.alias("_parse_error"), null.alias("_api_error"))
    return F.when(api.isNull() & F.coalesce(good, F.lit(False)), kept).otherwise(fallback)


def _as_struct(schema: str) -> str:
    head, tail = schema.split(", entities ")
    return ", ".join(p.replace(" ", ":", 1) for p in head.split(", ")) + ", entities:" + tail


def render_prompt(condition: Column, plain: Column, structured: Column) -> Column:
    """Label, blank line, then the text; structured prompts are rendered as JSON."""
    body = F.when(condition == "c", F.to_json(structured, {"ignoreNullFields": "false"})).otherwise(plain)
    label = F.when(condition == "c", F.lit(STRUCTURED_LABEL)).otherwise(F.lit(PLAIN_LABEL))
    return F.concat(label, F.lit("\n\n"), body)


def first_code_block(text: Column) -> Column:
    """Body of the first fenced block, trimmed; text without a fence is trimmed whole."""
    pattern = rf"(?is)```(?:{'|'.join(FENCE_LANGUAGES)})?\n(.*?)```"
    # One pattern pass decides most rows; only an empty body needs the second look.
    fenced = let(F.regexp_extract(text, pattern, 1), lambda body: F.when(
        (body != "") | F.regexp_like(text, F.lit(pattern)), body).otherwise(text))
    chosen = F.when(F.contains(text, F.lit("```")), fenced).otherwise(text)
    return F.coalesce(strip(chosen), F.lit(""))


def judge_prompt(template: str, response: Column, limit: int | None = None, **fields: Column) -> Column:
    """Fill `{name}` and `{response}` slots of a rubric supplied by the caller."""
    shown = F.substring(response, 1, limit) if limit else response
    slots = {**fields, "response": shown}
    pieces, rest = [], template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in slots if "{" + name + "}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), slots[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def count_tokens(text: Column) -> Column:
    """Estimate used when no usage record came back: words plus punctuation marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long")


def word_count(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def judge_score(reply: Column) -> tuple[Column, Column]:
    """(score, status) from a judge's reply.

    The span from the first `{` to the last `}` must be one JSON object; of repeated keys the last
    counts (a variant refuses them, so such a reply is read as a struct).  Numbers are cut
    to integers, integer strings are accepted, everything else scores 0.  The status keeps
    a failed judgement apart from a true 0.
    """
    def read(found: Column) -> Column:
        """The list around a span as a variant, and the score in it: each is parsed once, whatever asks for it."""
        listed = F.concat(F.lit("["), found, F.lit("]"))

        def scored(doc: Column) -> Column:
            last = F.from_json(listed, "array<struct<score:variant>>")
            single = let(F.when(doc.isNull(), last), lambda rows: F.when(F.size(rows) == 1, F.get(rows, F.lit(0))["score"]))
            return F.struct(found.alias("span"), doc.alias("doc"),
                            F.coalesce(F.try_variant_get(doc, "$[0].score", "variant"), single).alias("score"))

        return let(F.try_parse_json(listed), scored)

    def typed(row: Column) -> Column:
        return F.struct(row["span"].alias("span"), row["doc"].alias("doc"), row["score"].alias("score"),
                        F.schema_of_variant(row["score"]).alias("kind"))

    def number(row: Column) -> Column:
        kind, score = row["kind"], row["score"]
        as_number = F.try_variant_get(score, "$", "double").cast("long")
        return (
            F.when(kind == "STRING", let(F.try_variant_get(score, "$", "string"), lambda text: F.when(
                F.regexp_like(text, F.lit(r"^\s*[+-]?\d+\s*$")), strip(text).try_cast("long"))))
            .when(kind == "BOOLEAN", as_number)
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), as_number)
        )

    def problem(row: Column) -> Column:
        several = F.try_variant_get(row["doc"], "$[1]", "variant").isNotNull()
        return (
            F.when(reply.isNull(), "no_reply")
            .when(row["span"] == "", "no_json")
            .when((row["doc"].isNull() & row["score"].isNull()) | several, "bad_json")
            .when(row["kind"].isNull(), "no_score")
        )

    def of_reply(what: Callable[[Column], Column]) -> Column:
        return let(let(let(F.regexp_extract(reply, r"(?s)\{.*\}", 0), read), typed), what)

    value = of_reply(lambda row: F.when(problem(row).isNull(), number(row)))
    status = of_reply(lambda row: F.coalesce(problem(row), F.when(number(row).isNull(), "bad_score").otherwise("ok")))
    return F.coalesce(value, F.lit(0).cast("long")), status
