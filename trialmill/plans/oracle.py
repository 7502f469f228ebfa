"""DuckDB statements giving the same result as each registered query.

They are written independently of the operators: sequences are unnested and ranked with
windows, silhouettes and distances come from pair joins, tails from closed series.
"""

from __future__ import annotations

from ..fixed_values import CASE, CONDITIONS, CONTRACTIONS, FENCE_LANGUAGES, FILLERS, RULES, VALID_TOOLS
from .bindings import CODE_MENU, GOLD_MENU, INTENTS, MODELS, TOOL_MENU
from .catalog import COUNTED

HEX = "'0123456789abcdef'"
B = 200


def _lst(values) -> str:
    return "[" + ", ".join(_lst(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _digit(at: str) -> str:
    return f"instr({HEX}, substr(h, {at}, 1))"


_ALTS = "[" + ", ".join(_lst(g[2]) if g[2] else "CAST([] AS VARCHAR[][])" for g in GOLD_MENU) + "]"
PATTERN = r"(?i)TOOL_CALL:\s*([\p{L}\p{M}\p{N}_]+)\s*\(([^)]*)\)"

TASKS = f"""
tasks AS (
  SELECT 'task_' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(12, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') AS task_id, event_id AS task_no,
         list_extract({_lst(INTENTS)}, CAST(user_id % 8 + 1 AS INT)) AS intent, user_id AS owner,
         CAST(user_id % 4 AS INT) AS gold_no,
         CASE WHEN user_id % 2 = 0 THEN list_extract({_lst(list(RULES))}, CAST((user_id // 2) % {len(RULES)} + 1 AS INT)) END AS rule_id,
         event_type AS topic, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '[0-9]+') AS INT) AS k
  FROM events),
gold AS (
  SELECT task_id, list_extract({_lst([g[0] for g in GOLD_MENU])}, gold_no + 1) AS expected,
         list_extract({_lst([g[1] for g in GOLD_MENU])}, gold_no + 1) AS minimum,
         list_extract({_ALTS}, gold_no + 1) AS alts, rule_id IS NOT NULL AS has_unit_test
  FROM tasks WHERE owner % 50 <> 7)"""

RUNS = TASKS + f""",
hashed AS (
  SELECT t.*, model, condition, md5(concat_ws('-', CAST(task_no AS VARCHAR), condition, model)) AS h
  FROM tasks t, (SELECT unnest({_lst(MODELS)}) AS model), (SELECT unnest({_lst(CONDITIONS)}) AS condition)),
planned AS (
  SELECT *, ({_digit('1')} - 1) % 6 + CASE WHEN condition = 'c' THEN 1 ELSE 0 END AS n_calls,
         owner % 50 = 9 AND condition = 'b' AND model = 'm0' AS failed,
         CASE WHEN {_digit('15')} <= 4 THEN 'tool_call:' ELSE 'TOOL_CALL: ' END AS marker,
         {_digit('14')} <= 2 AS bare
  FROM hashed),
written AS (
  SELECT *, 'Notes on ' || topic || ' ' || k || '.' || chr(10)
    || array_to_string(list_transform(range(1, n_calls + 1), lambda i: marker
         || CASE WHEN i = 2 THEN upper(list_extract({_lst(TOOL_MENU)}, {_digit('CAST(i + 1 AS INT)')}))
                 ELSE list_extract({_lst(TOOL_MENU)}, {_digit('CAST(i + 1 AS INT)')}) END
         || '( path="src/item_' || k || '.py" )'), chr(10))
    || chr(10) || 'TOOL_CALL: git_diff' || chr(10) || CASE WHEN bare THEN '' ELSE '```python' END || chr(10)
    || array_to_string(list_transform(range(17, 22), lambda i: list_extract({_lst(CODE_MENU)}, {_digit('CAST(i AS INT)')})), ' ')
    || chr(10) || CASE WHEN bare THEN '' ELSE '```' END || chr(10) || 'Done.' AS body
  FROM planned),
runs AS (
  SELECT task_id || '_cond' || condition || '_' || model AS run_id, task_id, task_no, intent, condition, model, owner,
         rule_id, topic, k, CAST(n_calls AS BIGINT) AS planned_calls,
         CASE WHEN NOT failed THEN body END AS response,
         CAST(CASE WHEN failed THEN 0 ELSE 180 + k + instr('abc', condition) * 12 END AS BIGINT) AS input_tokens,
         CAST(CASE WHEN failed THEN 0 ELSE length(body) + n_calls * 9 END AS BIGINT) AS output_tokens,
         CAST((500 + (cents * 7 + {_digit('16')} * 31) % 4000) AS DOUBLE) / 1000 AS execution_time_sec,
         CASE WHEN failed THEN 'timeout after 60s on ' || topic END AS error
  FROM written),
called AS (
  SELECT *, input_tokens + output_tokens AS total_tokens,
         coalesce(list_transform(regexp_extract_all(response, '{PATTERN}', 1), lambda x: lower(x)), CAST([] AS VARCHAR[])) AS names
  FROM runs),
named AS (
  SELECT *, list_filter(names, lambda x: list_contains({_lst(VALID_TOOLS)}, x)) AS good_names,
         list_filter(names, lambda x: NOT list_contains({_lst(VALID_TOOLS)}, x)) AS bad_names
  FROM called)"""

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FENCE = "(?is)```(?:" + "|".join(FENCE_LANGUAGES) + r")?\n(.*?)```"


def _code(text: str) -> str:
    return (f"trim(CASE WHEN regexp_matches({text}, '{_FENCE}') THEN regexp_extract({text}, '{_FENCE}', 1) "
            f"ELSE {text} END, {_SPACES})")


_RULE_ROWS = ", ".join(
    f"('{rule}', {i}, {'false' if clause[0] == CASE else 'true'}, {_lst([w for w in clause if w != CASE])})"
    for rule, clauses in RULES.items() for i, clause in enumerate(clauses))
CHECKED = f""",
rules(rule_id, clause, ignore_case, any_of) AS (VALUES {_RULE_ROWS}),
coded AS (SELECT run_id, rule_id, {_code('response')} AS code FROM runs WHERE error IS NULL),
clause_hits AS (
  SELECT run_id, clause, bool_or(CASE WHEN ignore_case THEN contains(lower(code), word) ELSE contains(code, word) END) AS hit
  FROM (SELECT run_id, code, clause, ignore_case, unnest(any_of) AS word FROM coded JOIN rules USING (rule_id))
  GROUP BY run_id, clause),
checks AS (
  SELECT c.run_id, bool_and(hit) AS functional_correct
  FROM coded c LEFT JOIN clause_hits h USING (run_id) GROUP BY c.run_id)"""

SEQUENCES = """,
paired AS (
  SELECT n.*, expected, minimum, list_concat([expected], alts) AS candidates
  FROM named n JOIN gold USING (task_id) WHERE error IS NULL),
candidate AS (
  SELECT run_id, names, unnest(candidates) AS seq, generate_subscripts(candidates, 1) AS i FROM paired),
rated AS (
  SELECT run_id, i, coalesce(seq[1] = names[1], false) AS starts,
         len(list_filter(list_distinct(names), lambda x: list_contains(seq, x))) AS hits,
         len(list_distinct(names)) AS na, len(list_distinct(seq)) AS ne
  FROM candidate),
rates AS (
  SELECT *, CASE WHEN na = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / na END AS p,
         CASE WHEN ne = 0 THEN 0 ELSE CAST(hits AS DOUBLE) / ne END AS r FROM rated),
f1s AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM rates),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, i) AS rn, max(f1) OVER (PARTITION BY run_id) AS top
  FROM f1s),
best AS (
  SELECT run_id, round(max(p) FILTER (rn = 1), 4) AS tool_precision, round(max(r) FILTER (rn = 1), 4) AS tool_recall,
         round(max(top), 4) AS tool_f1, CAST(bool_or(f1 = top AND starts) AS BIGINT) AS first_call_correct
  FROM ranked GROUP BY run_id)"""

_TAU = """CASE WHEN len(ranks) < 2 THEN NULL ELSE coalesce(
    CAST(list_sum(list_transform(range(2, len(ranks) + 1), lambda j: list_sum(list_transform(range(1, j), lambda i:
      CASE WHEN ordered[j] > ordered[i] THEN sign(ranks[j] - ranks[i]) ELSE 0 END)))) AS DOUBLE)
    / nullif(CAST(list_sum(list_transform(range(2, len(ranks) + 1), lambda j: list_sum(list_transform(range(1, j), lambda i:
      CASE WHEN ordered[j] > ordered[i] THEN 1 ELSE 0 END)))) AS DOUBLE), 0), 0) END"""
TAUS = f""",
ranking AS (
  SELECT run_id, list_transform(good_names, lambda t: CAST(CASE WHEN list_contains(expected, t)
           THEN len(expected) - list_position(list_reverse(expected), t) ELSE len(expected) END AS INT)) AS ranks
  FROM paired),
taus AS (SELECT run_id, {_TAU} AS tau FROM (SELECT run_id, ranks, list_sort(ranks) AS ordered FROM ranking))"""

SCORED = RUNS + CHECKED + SEQUENCES + TAUS + """,
scored AS (
  SELECT p.*, b.tool_precision, b.tool_recall, b.tool_f1, b.first_call_correct, c.functional_correct,
         CAST(len(names) AS BIGINT) AS total_tool_calls, CAST(len(names) - len(list_distinct(names)) AS BIGINT) AS redundant_calls,
         CAST(len(list_filter(minimum, lambda x: NOT list_contains(names, x))) = 0 AS BIGINT) AS min_req_met,
         CAST(least(2, len(bad_names)) AS BIGINT) AS hallucination_score,
         CAST((owner + len(names)) % 4 AS BIGINT) AS intent_fidelity_score,
         CASE WHEN len(names) = 0 THEN 0.0 ELSE CAST(len(bad_names) AS DOUBLE) / len(names) END AS tool_halluc_rate,
         CAST(len(names) > 0 AS INT)::DOUBLE AS format_compliance, t.tau AS kendall_tau
  FROM paired p JOIN best b USING (run_id) JOIN checks c USING (run_id) JOIN taus t USING (run_id))"""

# Non-ASCII letters become ASCII word characters while patterns run, because word borders
# here only know ASCII letters.
_LETTERS = "éèêçñóüöäßíáúàìòùâîôûëïœæåøã"


def _ascii(text: str) -> str:
    for i, ch in enumerate(_LETTERS):
        text = f"replace({text}, '{ch}', 'zq{i:02d}qz')"
    return text


def _unascii(text: str) -> str:
    for i, ch in enumerate(_LETTERS):
        text = f"replace({text}, 'zq{i:02d}qz', '{ch}')"
    return text


def _expand(text: str) -> str:
    for word, full in CONTRACTIONS.items():
        text = f"regexp_replace({text}, '\\b{word.replace(chr(39), chr(39) * 2)}\\b', '{full}', 'g')"
    return text


def _defill(text: str) -> str:
    return f"regexp_replace({text}, '(?i)\\b({'|'.join(FILLERS)})\\b', '', 'g')"


UTTERANCES = f"""
utterances AS (
  SELECT doc_id, list_extract({_lst(INTENTS)}, CAST(doc_id % 8 + 1 AS INT)) AS intent,
    CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', '. Um, you know what I mean,  it''s ')
         WHEN 1 THEN replace(text, ', ', ' kind of. I''m   sure they''re ')
         WHEN 2 THEN 'Okay so ' || replace(text, '. ', ' Hmm, like, DON''T and let''s. ')
         ELSE text END AS utterance, lang AS language,
    CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE source END AS framework,
    CASE doc_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'key error' END AS error_type, source, n_chars
  FROM documents)"""
_PLAIN = _ascii("lower(utterance)")
CLEANED = UTTERANCES + f""",
bare AS (SELECT *, trim(regexp_replace({_unascii(_defill(_expand(_PLAIN)))}, '\\s+', ' ', 'g')) AS t FROM utterances),
capital AS (SELECT *, upper(substr(t, 1, 1)) || substr(t, 2) AS u FROM bare),
cleaned AS (SELECT *, CASE WHEN u <> '' AND right(u, 1) NOT IN ('.', '!', '?') THEN u || '.' ELSE u END AS cleaned FROM capital)"""


def _present(col: str) -> str:
    return f"coalesce(trim({col}) NOT IN ('', 'nan'), false)"


VECTORS = """
v AS (SELECT vec_id, CAST(label AS INT) AS label, CAST(embedding AS DOUBLE[]) AS vec, CAST(vec_id % 6 AS INT) AS cluster,
             vec_id % 4 AS entity_count FROM embeddings),
parts AS (SELECT vec_id, label, cluster, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v),
means AS (SELECT label, cluster, d, avg(x) AS m FROM parts GROUP BY ALL)"""
DISTANCES = VECTORS + """,
dist AS (SELECT p.vec_id, p.label, p.cluster, sqrt(sum((x - m) * (x - m))) AS distance
         FROM parts p JOIN means USING (label, cluster, d) GROUP BY ALL)"""
ASSIGNED = VECTORS + """,
gaps AS (SELECT p.vec_id, p.label, c.cluster, sum((x - m) * (x - m)) AS d2
         FROM parts p JOIN means c ON p.label = c.label AND p.d = c.d GROUP BY ALL),
picks AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rn FROM gaps),
assigned AS (SELECT vec_id, label, cluster, d2 FROM picks WHERE rn = 1)"""
REPS = DISTANCES + """,
tied AS (SELECT d.*, entity_count, min(distance) OVER (PARTITION BY d.label, d.cluster) AS lo FROM dist d JOIN v USING (vec_id)),
reps AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY entity_count DESC, vec_id) AS rn
    FROM tied WHERE abs(distance - lo) <= 1e-6 + 1e-5 * lo) WHERE rn = 1)"""

REPLIES = TASKS + """,
raws AS (SELECT *, 'please handle ' || topic || ' number ' || k AS raw FROM tasks),
goods AS (SELECT *, '{"raw_utterance": "' || raw || '", "normalized": "handle ' || topic || '", "intent": "' || intent
   || '", "confidence_score": 0.' || lpad(CAST(k AS VARCHAR), 2, '0') || ', "entities": {"error_type": null, "component": "'
   || topic || '", "language": "sql", "framework": null}}' AS good FROM raws),
replies AS (SELECT task_id, raw, CASE topic WHEN 'click' THEN '```json' || chr(10) || good || chr(10) || '```'
   WHEN 'error' THEN 'Sure! ' || good WHEN 'view' THEN good || ' extra words' WHEN 'purchase' THEN good END AS reply,
   CASE WHEN topic = 'signup' THEN 'rate limit' END AS api_error FROM goods),
stripped AS (SELECT *, trim(replace(replace(trim(reply), '```json', ''), '```', ''), chr(10) || ' ') AS doc FROM replies),
parsed AS (SELECT *, api_error IS NULL AND coalesce(json_valid(doc), false) AS ok FROM stripped)"""

JUDGE = TASKS + """,
replies AS (SELECT task_id, CASE owner % 12
   WHEN 0 THEN '{"score": ' || k || ', "reasoning": "fine"}'
   WHEN 1 THEN 'Verdict:' || chr(10) || '{"score": ' || k || '.7, "claims": [{"x": 1}]}' || chr(10) || 'Done.'
   WHEN 2 THEN '{"score": "' || k || '"}' WHEN 3 THEN '{"score": ' || k || ', }' WHEN 4 THEN 'I cannot judge this.'
   WHEN 5 THEN NULL WHEN 6 THEN '{"reasoning": "' || topic || '"}' WHEN 7 THEN '{"score": "' || k || '.5"}'
   WHEN 8 THEN '{"score": ' || k || '} and {"score": 1}' WHEN 9 THEN '{"score": true}'
   WHEN 10 THEN '{"score": 1, "why": "a", "score": ' || k || '}' ELSE '{"score": null}' END AS reply
   FROM tasks),
spans AS (SELECT *, replace(regexp_extract(reply, '(?s)\\{.*\\}'), '"score": 1, "why": "a", ', '') AS span FROM replies),
docs AS (SELECT *, json_valid(span) AND NOT regexp_matches(span, ',\\s*[\\}\\]]') AS fine, CASE WHEN fine THEN json_type(span, '$.score') END AS kind,
                CASE WHEN fine THEN json_extract_string(span, '$.score') END AS raw FROM spans),
vals AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN CASE WHEN regexp_full_match(raw, '\\s*[+-]?\\d+\\s*') THEN CAST(trim(raw) AS BIGINT) END
   WHEN kind = 'BOOLEAN' THEN CASE WHEN raw = 'true' THEN 1 ELSE 0 END
   WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT) END AS value FROM docs)"""


# --- closed forms -------------------------------------------------------------------

def _t_p(t: str, df: str) -> str:
    """Two-sided t tail by the full finite series."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    log_cos2 = f"ln(pow(cos({theta}), 2))"
    odd = (f"2 / pi() * ({theta} + CASE WHEN {df} = 1 THEN 0 ELSE sin({theta}) * cos({theta}) * list_sum(list_transform("
           f"range(0, CAST(({df} - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + k * {log_cos2}))) "
           f"* sqrt(pi()) / 2 END)")
    even = (f"sin({theta}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) + k * {log_cos2}))) / sqrt(pi())")
    return f"1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END"


def _t_crit(df: str) -> str:
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join([f"{z!r}"] + [f"{c!r} / pow({df}, {i})" for i, c in enumerate(terms, 1)]) + ")"


def _f_p(f: str, df1: str, df2: str) -> str:
    y = f"({df2} / ({df2} + {df1} * {f}))"
    return (f"CASE {df1} WHEN 2 THEN pow({y}, {df2} / 2.0) "
            f"WHEN 4 THEN pow({y}, {df2} / 2.0) * (1 + {df2} / 2.0 * (1 - {y})) END")


def _binom_p(k: str, n: str) -> str:
    return (f"least(1.0, 2 * list_sum(list_transform(range(0, CAST({k} + 1 AS BIGINT)), lambda i: "
            f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0)))))")


def _boot(keys: list[str], cells: str, salt: list[str], estimate: str) -> str:
    """CTEs from a `cells` select (keys, x[, y], n) to `bounds(keys, ci_lower, ci_upper)`.

    A draw is the first count whose cumulative Poisson probability is above the uniform number; `low` is the
    probability of all smaller counts.
    """
    k = ", ".join(keys)
    salted = ", ".join(keys + [f"CAST(CAST({c} AS DECIMAL(38,12)) AS VARCHAR)" for c in salt])
    reach = "CAST(ceil(8 * sqrt(n)) AS BIGINT) + 20"
    return f""",
cells AS MATERIALIZED ({cells}),
digests AS (SELECT *, md5(concat_ws('-', {salted}, CAST(b AS VARCHAR))) AS dg FROM cells, (SELECT unnest(range(0, {B})) AS b)),
units AS (SELECT *, (CAST('0x' || substr(dg, 1, 13) AS BIGINT) + 0.5::DOUBLE) / {2.0 ** 52}::DOUBLE AS u FROM digests),
counts AS (SELECT n, unnest(range(greatest(0, n - ({reach})), n + {reach} + 1)) AS k FROM (SELECT DISTINCT n FROM cells)),
masses AS (SELECT n, k, exp(k * ln(n) - n - lgamma(k + 1.0)) AS mass FROM counts),
tables AS MATERIALIZED (SELECT n, k, coalesce(sum(mass) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
           FROM masses),
draws AS (SELECT q.*, CAST(t.k AS DOUBLE) AS w FROM units q ASOF JOIN tables t ON q.n = t.n AND q.u >= t.low),
estimates AS (SELECT {k}, b, {estimate} AS e FROM draws GROUP BY {k}, b),
bounds AS (SELECT {k}, quantile_cont(e, 0.025) AS ci_lower, quantile_cont(e, 0.975) AS ci_upper
           FROM estimates WHERE e IS NOT NULL GROUP BY {k})"""


def _boot_ratio() -> str:
    return _boot(["condition"], "SELECT condition, total_tokens AS x, min_req_met AS y, count(*) AS n FROM scored GROUP BY ALL",
                 ["x", "y"], "CASE WHEN sum(w * y) > 0 THEN sum(w * x) / sum(w * y) END")


def _boot_mean(keys: list[str], source: str, value: str) -> str:
    k = ", ".join(keys)
    return _boot(keys, f"SELECT {k}, CAST({value} AS DOUBLE) AS x, count(*) AS n FROM {source} "
                 f"WHERE {value} IS NOT NULL GROUP BY ALL", ["x"], "sum(w * x) / nullif(sum(w), 0)")


def _fig_mean(keys: list[str], value: str, source: str = "scored", head: str = SCORED) -> str:
    k = ", ".join(keys)
    return (f"WITH {head}{_boot_mean(keys, source, value)}, centre AS (SELECT {k}, avg(CAST({value} AS DOUBLE)) AS m "
            f"FROM {source} GROUP BY {k}) SELECT {k}, round(m, 4) AS mean, round(ci_lower, 4) AS ci_lower, "
            f"round(ci_upper, 4) AS ci_upper FROM centre LEFT JOIN bounds USING ({k})")


def _means(keys: list[str], measures: dict[str, str]) -> str:
    k = ", ".join(keys)
    cols = ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 4) AS {n}" for n, c in measures.items())
    return f"WITH {SCORED} SELECT {k}, {cols} FROM scored GROUP BY {k}"


def _pivot(index: str, measures: dict[str, str]) -> str:
    cols = ", ".join(f"round(avg(CAST({c} AS DOUBLE)) FILTER (condition = '{x}'), 4) AS {n}_{x}"
                     for n, c in measures.items() for x in CONDITIONS)
    return f"WITH {SCORED} SELECT {index}, {cols} FROM scored GROUP BY {index}"


def _wide(value: str, source: str = "scored") -> str:
    cols = ", ".join(f"avg(CAST({value} AS DOUBLE)) FILTER (condition = '{c}') AS {c}" for c in CONDITIONS)
    return f"wide AS (SELECT task_id, model, {cols} FROM {source} GROUP BY task_id, model)"


def _mcnemar(value: str, x: str, y: str) -> str:
    return (f"WITH {SCORED}, {_wide(value)}, tab AS (SELECT count(*) FILTER ({x} = 1 AND {y} = 1) AS yy, "
            f"count(*) FILTER ({x} = 1 AND {y} = 0) AS yn, count(*) FILTER ({x} = 0 AND {y} = 1) AS ny, "
            f"count(*) FILTER ({x} = 0 AND {y} = 0) AS nn FROM wide) "
            f"SELECT yy, yn, ny, nn, round({_binom_p('least(yn, ny)', '(yn + ny)')}, 6) AS p FROM tab")


_D_OF = ("CASE WHEN n1 < 2 OR n2 < 2 THEN 0.0 ELSE coalesce(round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) "
         "/ (n1 + n2 - 2)), 0), 4), 0.0) END")


def _ttest() -> str:
    legs = " UNION ALL ".join(
        f"SELECT '{a}' AS f, '{c}' AS s, {a} AS x, {c} AS y FROM wide WHERE {a} IS NOT NULL AND {c} IS NOT NULL"
        for a, c in (("a", "c"), ("a", "b"), ("b", "c")))
    half1, half2 = (f"{_t_crit('(n - 1)')} * sqrt({v}) / sqrt(n)" for v in ("v2", "v1"))
    return f"""WITH {SCORED}, {_wide('tool_f1')}, legs AS ({legs}),
st AS (SELECT f, s, count(*) AS n, avg(x) AS m2, avg(y) AS m1, var_samp(x) AS v2, var_samp(y) AS v1,
       avg(y - x) / (stddev_samp(y - x) / sqrt(count(*))) AS t, count(*) AS n1, count(*) AS n2 FROM legs GROUP BY f, s),
pp AS (SELECT *, {_t_p('t', '(n - 1)')} AS p_raw FROM st)
SELECT f AS "first", s AS "second", n, round(m2, 4) AS mean_first, round(m2 - {half1}, 4) AS first_low,
  round(m2 + {half1}, 4) AS first_high, round(m1, 4) AS mean_second, round(m1 - {half2}, 4) AS second_low,
  round(m1 + {half2}, 4) AS second_high, round(t, 4) AS t, round(p_raw, 6) AS p, {_D_OF} AS d,
  p_raw < 0.05 / 12 AS significant FROM pp"""


def _anova(by: str, factor: str, levels: int | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    enough = "least_n > 2" + (f" AND k = {levels}" if levels else "")
    return f"""WITH {SCORED},
devs AS (SELECT {lead}{factor} AS fac, tool_f1 AS x, avg(tool_f1) OVER ({part}) AS g FROM scored),
st AS (SELECT {lead}fac, count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS ss, max(g) AS g FROM devs GROUP BY {lead}fac),
su AS (SELECT {lead}count(*) AS k, sum(n) AS total, min(n) AS least_n, sum(n * (m - g) * (m - g)) AS ssb, sum(ss) AS ssw FROM st {group}),
ff AS (SELECT *, CAST(k - 1 AS BIGINT) AS df1, CAST(total - k AS BIGINT) AS df2,
       CASE WHEN {enough} THEN (ssb / (k - 1)) / (ssw / (total - k)) END AS fr FROM su)
SELECT {lead}df1, df2, round(fr, 4) AS f, round({_f_p('fr', 'df1', 'df2')}, 6) AS p,
  CASE WHEN {enough} THEN 'ok' ELSE 'insufficient' END AS status FROM ff"""


def _two_way() -> str:
    return f"""WITH {SCORED},
full_tasks AS (SELECT task_id FROM scored GROUP BY task_id HAVING count(*) = 9),
x AS (SELECT condition AS c, model AS m, tool_f1 AS y FROM scored WHERE task_id IN (SELECT task_id FROM full_tasks)),
tot AS (SELECT count(*) AS n, avg(y) AS g, sum(y * y) - count(*) * avg(y) * avg(y) AS sst FROM x),
byc AS (SELECT sum(n * (a - g) * (a - g)) AS ss, count(*) AS lv FROM (SELECT count(*) AS n, avg(y) AS a FROM x GROUP BY c), (SELECT g FROM tot)),
bym AS (SELECT sum(n * (a - g) * (a - g)) AS ss, count(*) AS lv FROM (SELECT count(*) AS n, avg(y) AS a FROM x GROUP BY m), (SELECT g FROM tot)),
bycm AS (SELECT sum(n * (a - g) * (a - g)) AS ss FROM (SELECT count(*) AS n, avg(y) AS a FROM x GROUP BY c, m), (SELECT g FROM tot)),
terms AS (
  SELECT 'condition' AS term, byc.ss AS ss, byc.lv - 1 AS df1 FROM byc
  UNION ALL SELECT 'model', bym.ss, bym.lv - 1 FROM bym
  UNION ALL SELECT 'interaction', bycm.ss - byc.ss - bym.ss, (byc.lv - 1) * (bym.lv - 1) FROM bycm, byc, bym),
ff AS (SELECT term, t.ss, df1, tot.n - byc.lv * bym.lv AS df2,
       (t.ss / df1) / ((tot.sst - bycm.ss) / (tot.n - byc.lv * bym.lv)) AS fr FROM terms t, tot, bycm, byc, bym)
SELECT term, round(ss, 4) AS ss, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round(fr, 4) AS f,
  round({_f_p('fr', 'df1', 'df2')}, 6) AS p FROM ff"""


_OVERALL = {
    "intent_fidelity": "intent_fidelity_score", "tool_f1": "tool_f1", "hallucination_mean": "hallucination_score",
    "first_call_acc": "first_call_correct", "min_req_met": "min_req_met", "format_compliance": "format_compliance",
    "tool_halluc_rate": "tool_halluc_rate", "func_correct_rate": "CAST(functional_correct AS INT)",
    "redundancy": "redundant_calls", "kendall_tau": "kendall_tau", "avg_tokens": "total_tokens",
    "avg_output_tokens": "output_tokens", "avg_latency": "execution_time_sec",
}


def _overall() -> str:
    cols = ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 4) AS {n}" for n, c in _OVERALL.items())
    return (f"WITH {SCORED}{_boot_ratio()}, tab AS (SELECT condition, {cols}, "
            "round(CAST(sum(total_tokens) AS DOUBLE) / nullif(sum(scored.min_req_met), 0), 4) AS cpstc FROM scored GROUP BY condition) "
            "SELECT tab.*, round(ci_lower, 4) AS ci_lower, round(ci_upper, 4) AS ci_upper FROM tab LEFT JOIN bounds USING (condition)")


_SEQ = RUNS + SEQUENCES
_STORED = """SELECT run_id, CASE WHEN topic <> 'view' THEN planned_calls / 10.0::DOUBLE END AS tool_f1,
  CAST(CASE WHEN topic <> 'view' THEN k % 3 END AS BIGINT) AS intent_fidelity_score FROM runs WHERE error IS NULL AND topic <> 'signup'"""
_THIN = RUNS + """, thin AS (SELECT run_id, topic, planned_calls AS total_tool_calls, CAST(k % 4 AS BIGINT) AS intent_fidelity_score
  FROM runs WHERE error IS NULL)"""
_GRID = TASKS + f""", grid AS (SELECT task_id || '_cond' || condition || '_' || model AS run_id, task_id, task_no, model, condition
  FROM tasks, (SELECT unnest({_lst(MODELS)}) AS model), (SELECT unnest({_lst(CONDITIONS)}) AS condition))"""
_PROMPTS = f""", long AS (
  SELECT doc_id, 'a' AS condition, utterance AS plain, NULL AS doc FROM cleaned
  UNION ALL SELECT doc_id, 'b', cleaned, NULL FROM cleaned
  UNION ALL SELECT doc_id, 'c', NULL, CAST(to_json({{'raw_utterance': utterance, 'normalized': cleaned, 'intent': intent,
     'entities': {{'error_type': CASE WHEN {_present('error_type')} THEN error_type END, 'language': language}}}}) AS VARCHAR) FROM cleaned)"""
_JUDGE_TEXT = "'A developer asked: \"' || {ref} || '\"' || chr(10) || 'The assistant answered: \"' || {text} || '\"' || chr(10) || 'Reply with JSON: {{\"score\": X}}'"


def _pct(col: str) -> str:
    return f"round(100 * avg(CAST({_present(col)} AS INT)), 4) AS {col}_pct"


# Normal probabilities by cumulated sums with their end correction, looked up and carried on by Taylor's series; critical
# values by inverse interpolation of the tail at seven places around the root for three groups and many rows.
_HSD = f"""WITH {SCORED},
    s AS (SELECT condition, model, count(tool_f1) AS n, avg(tool_f1) AS m, var_samp(tool_f1) AS v FROM scored GROUP BY ALL),
    e AS (SELECT condition, sum((n - 1) * v) / (sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df, count(*) AS k FROM s GROUP BY 1),
    pairs AS (SELECT x.condition, x.model AS a, y.model AS b, df, k, y.m - x.m AS gap, sqrt(mse / 2 * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)) AS se
      FROM s x JOIN s y ON x.condition = y.condition AND x.model < y.model JOIN e ON e.condition = x.condition),
    asked AS (SELECT condition, a, b, -1 AS j, abs(gap) / se AS q, df, k FROM pairs
      UNION ALL SELECT condition, NULL, NULL, j, 3.25::DOUBLE + j * 0.02::DOUBLE, df, k FROM e, range(7) r(j)),
    steps AS (SELECT i, i / 256.0::DOUBLE AS x, exp(-0.5::DOUBLE * i * i / 65536) / sqrt(2 * pi()) AS d FROM range(-2560, 2561) r(i)),
    normal AS (SELECT i, x, d, (sum(d) OVER (ORDER BY i) - d / 2) / 256 + x * d / 12 / 65536 AS p FROM steps),
    outer_nodes AS (SELECT *, i / 4.0::DOUBLE / sqrt(2 * df) AS u FROM asked, range(-36, 37) r(i)),
    weighed AS (SELECT condition, a, b, j, k, i, q * exp(u) AS w, exp(-df / 2.0::DOUBLE * (exp(2 * u) - 1 - 2 * u)) AS height FROM outer_nodes),
    placed AS (SELECT o.*, z.d AS zd, z.p AS zp, z.x - w AS y FROM weighed o, normal z WHERE z.i % 16 = 0 AND abs(z.x) <= 8),
    looked AS (SELECT t.*, CASE WHEN y < -9.5 THEN 0 ELSE g.p + g.d * ((y - g.x) - g.x * (y - g.x) ** 2 / 2 + (g.x ** 2 - 1) * (y - g.x) ** 3 / 6) END AS yp
      FROM placed t JOIN normal g ON g.i = CAST(round(greatest(y, -9.5) * 256) AS BIGINT)),
    within AS (SELECT condition, a, b, j, i, height, k * sum(zd / 16 * greatest(zp - yp, 0) ** (k - 1)) AS chance FROM looked GROUP BY condition, a, b, j, i, height, k),
    tails AS (SELECT condition, a, b, j, 1 - sum(height * chance) / sum(height) AS p FROM within GROUP BY condition, a, b, j),
    parts AS (SELECT x.condition, x.j, product((0.05 - y.p) / (x.p - y.p)) AS part FROM tails x JOIN tails y
      ON x.condition = y.condition AND x.j <> y.j AND x.j >= 0 AND y.j >= 0 GROUP BY ALL),
    bound AS (SELECT condition, sum((3.25::DOUBLE + j * 0.02::DOUBLE) * part) AS c FROM parts GROUP BY 1)
    SELECT p.condition, p.a AS "first", p.b AS "second", df, round(gap, 4) AS mean_diff, round(abs(gap) / se, 4) AS q, round(greatest(t.p, 0), 6) AS p,
      round(gap - c * se, 4) AS ci_lower, round(gap + c * se, 4) AS ci_upper, t.p < 0.05 AS significant
    FROM pairs p JOIN tails t ON p.condition = t.condition AND p.a = t.a AND p.b = t.b JOIN bound ON bound.condition = p.condition"""

_PHRASES = """WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
    phrases AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b)),
    found AS (SELECT doc_id, phrase FROM documents JOIN (SELECT DISTINCT phrase FROM phrases) ON contains(text, phrase)),
    needs AS (SELECT item_id, count(*) AS needed FROM phrases GROUP BY 1),
    held AS (SELECT doc_id, item_id, count(*) AS n FROM found JOIN phrases USING (phrase) GROUP BY ALL),
    passing AS (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS passed FROM held JOIN needs USING (item_id)
      WHERE n = needed GROUP BY 1)
    SELECT doc_id, hits, coalesce(passed, '') AS passed FROM (SELECT doc_id, count(*) AS hits FROM found GROUP BY 1) LEFT JOIN passing USING (doc_id)"""


def statements() -> dict[str, str]:
    rows = _row_statements()
    return rows | {f"{name}_counts": _count_statement(rows[name], *columns) for name, columns in COUNTED.items()}


def _count_statement(rows: str, scores: list[str], further: list[str]) -> str:
    tuples = [f"CAST(round({c} * 10000) AS BIGINT) AS {c}" for c in scores] + further
    return f"SELECT {', '.join(tuples)}, count(*) AS n FROM ({rows}) GROUP BY ALL"


def _row_statements() -> dict[str, str]:
    words = f"CASE WHEN trim(utterance, {_SPACES}) = '' THEN 0 ELSE len(regexp_split_to_array(trim(utterance, {_SPACES}), '\\s+')) END"
    spread = "sum(m * d)"
    return {
        "kmeans_fixpoint": """SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(0 AS BIGINT) AS misplaced,
            least(6, count(DISTINCT embedding)) AS clusters FROM embeddings GROUP BY label""",
        "bootstrap_cpstc_cover": f"""WITH {SCORED} SELECT condition, count(*) AS n,
            round(CAST(sum(total_tokens) AS DOUBLE) / sum(min_req_met), 4) AS ratio, true AS covered FROM scored GROUP BY condition""",
        "corpus_from_csv": """SELECT doc_id, nullif(text, '') AS utterance, nullif(lang, '') AS language, n_chars, round(n_chars / 7.0::DOUBLE, 4) AS share
            FROM documents""",
        "records_from_json": "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations",
        "records_from_json_lines": "SELECT item_id, text, len(string_split(text, ' ')) AS n_words FROM benchmark",
        "score_snapshot": f"""WITH {RUNS} SELECT run_id, planned_calls AS total_tool_calls, CAST(k % 4 AS BIGINT) AS intent_fidelity_score,
            CAST(NULL AS DOUBLE) AS tool_f1 FROM runs WHERE error IS NULL""",
        "small_classes": """SELECT n_chars, doc_id, source, CAST(0 AS BIGINT) AS cluster FROM documents
            QUALIFY count(*) OVER (PARTITION BY n_chars) = 1""",
        "merged_gold": f"WITH {TASKS} SELECT task_id, array_to_string(CASE WHEN len(expected) > 3 THEN minimum ELSE expected END, ',') AS expected FROM gold",
        "schema_evolve_scores": f"WITH {RUNS} SELECT run_id, planned_calls AS total_tool_calls, CAST(NULL AS DOUBLE) AS tool_f1, "
            "CAST(NULL AS BIGINT) AS intent_fidelity_score, CAST(NULL AS BOOLEAN) AS functional_correct FROM runs",
        "upsert_results": f"""WITH {RUNS}, again AS (SELECT * FROM called WHERE error IS NOT NULL OR topic = 'purchase'),
            rows_ AS (SELECT run_id, model, condition, total_tokens, error, 1 AS version FROM called
              UNION ALL SELECT run_id, model, condition, total_tokens + 7, NULL, 2 FROM again
              UNION ALL SELECT run_id, model, condition, total_tokens + 11, error, 3 FROM again WHERE k > 50)
            SELECT run_id, model, condition, total_tokens, error, CAST(version AS BIGINT) AS version FROM (
              SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY version DESC) AS rn FROM rows_) WHERE rn = 1""",
        "partial_update_scores": f"""WITH {_THIN} SELECT run_id, total_tool_calls, CASE WHEN topic = 'view'
            THEN CASE WHEN total_tool_calls > 2 THEN 3 END ELSE intent_fidelity_score END AS intent_fidelity_score FROM thin""",
        "ensure_score_keys": f"""WITH {_THIN} SELECT run_id, CASE WHEN topic <> 'signup' THEN total_tool_calls END AS total_tool_calls,
            CASE WHEN topic <> 'signup' THEN intent_fidelity_score END AS intent_fidelity_score FROM thin""",
        "task_lookup": f"""WITH {TASKS} SELECT task_id, intent, topic, CAST(k AS BIGINT) AS k FROM tasks
            WHERE task_no IN (3, 102, 203, 304, 403, 502, 605, 701)""",
        "intent_distribution": f"WITH {UTTERANCES} SELECT intent, count(*) AS n FROM utterances GROUP BY intent",
        "corpus_profile": f"""WITH {UTTERANCES}, counted AS (SELECT *, {words} AS w FROM utterances)
            SELECT intent, count(*) AS n, round(avg(w), 4) AS words_mean, CAST(min(w) AS BIGINT) AS words_min,
            CAST(max(w) AS BIGINT) AS words_max, round(stddev_samp(w), 4) AS words_std, {_pct('language')}, {_pct('framework')},
            {_pct('error_type')} FROM counted GROUP BY intent""",
        "entity_richness": f"""WITH {UTTERANCES} SELECT doc_id, CAST({' + '.join(f"CAST({_present(c)} AS INT)" for c in
            ('language', 'framework', 'error_type'))} AS BIGINT) AS entity_count FROM utterances""",
        "embedding_normalize": f"""WITH {VECTORS}, norms AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM parts GROUP BY vec_id)
            SELECT p.vec_id, round(sqrt(sum((x / l) * (x / l))), 6) AS unit_norm, round(sum(x / l * d), 6) AS weighted_sum
            FROM parts p JOIN norms USING (vec_id) GROUP BY p.vec_id""",
        "lloyd_step": f"""WITH {ASSIGNED}, moved AS (SELECT a.label, a.cluster, p.d, avg(x) AS m FROM assigned a JOIN parts p USING (vec_id) GROUP BY ALL),
            sizes AS (SELECT label, cluster, count(*) AS n, sum(d2) AS inertia FROM assigned GROUP BY ALL)
            SELECT CAST(s.label AS BIGINT) AS label, CAST(s.cluster AS BIGINT) AS cluster, n, round(any_value(inertia), 6) AS inertia,
            round({spread}, 6) AS weighted_sum FROM sizes s JOIN moved USING (label, cluster) GROUP BY s.label, s.cluster, n""",
        "centroid_distance": f"WITH {DISTANCES} SELECT vec_id, round(distance, 6) AS distance FROM dist",
        "cluster_representatives": f"""WITH {REPS} SELECT CAST(label AS BIGINT) AS label, CAST(cluster AS BIGINT) AS cluster, vec_id,
            round(distance, 6) AS distance FROM reps""",
        "task_ids": f"""WITH {REPS} SELECT label || '_' || format('{{:03d}}', row_number() OVER (PARTITION BY label ORDER BY cluster))
            AS task_id, vec_id FROM reps""",
        "append_composites": f"""WITH {UTTERANCES} SELECT 'doc_' || doc_id AS task_id, intent, length(utterance) AS n_chars,
            'dataset_sampled' AS source, CAST(0 AS BIGINT) AS cluster, CAST(NULL AS VARCHAR) AS sub_intents,
            {', '.join(f"CASE WHEN {_present(c)} THEN {c} END AS {c}" for c in ('language', 'framework', 'error_type'))} FROM utterances
            UNION ALL SELECT 'composite_' || item_id, 'composite', length(text), 'manually_authored', NULL, 'debug,test', NULL, NULL, NULL FROM benchmark""",
        "tasks_master": f"""WITH {TASKS} SELECT task_id, intent, array_to_string(expected, ',') AS expected,
            array_to_string(minimum, ',') AS minimum, CAST(len(alts) AS BIGINT) AS alternatives, has_unit_test FROM tasks JOIN gold USING (task_id)""",
        "missing_gold": f"WITH {TASKS} SELECT task_id, intent FROM tasks WHERE task_id NOT IN (SELECT task_id FROM gold)",
        "task_quality_report": f"""WITH {TASKS}, m AS (SELECT task_id, topic || ' ' || k || ' ' || intent AS txt, expected, minimum, has_unit_test
              FROM tasks JOIN gold USING (task_id))
            SELECT count(*) AS n_tasks, count(*) FILTER (len(expected) < 1) AS empty_expected, count(*) FILTER (len(minimum) < 1) AS empty_minimum,
            count(*) FILTER (len(expected) <= 2) AS empty_embeddings,
            count(*) FILTER (has_unit_test) AS with_tests, count(*) FILTER (NOT has_unit_test) AS without_tests,
            (SELECT count(*) FROM (SELECT task_id FROM m GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count(DISTINCT task_id) AS distinct_task_id,
            (SELECT count(*) FROM (SELECT txt FROM m GROUP BY 1 HAVING count(*) > 1)) AS repeated_texts, count(DISTINCT txt) AS distinct_raw_utterance FROM m""",
        "silhouette_exact": f"""WITH {ASSIGNED}, pts AS (SELECT a.*, vec FROM assigned a JOIN v USING (vec_id)),
            pair AS (SELECT x.label, x.vec_id, x.cluster AS own, y.cluster AS other, sum(list_distance(x.vec, y.vec)) AS s, count(*) AS n
              FROM pts x JOIN pts y ON x.label = y.label GROUP BY ALL),
            ab AS (SELECT label, vec_id, max(n) FILTER (own = other) AS own_n, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a,
              min(s / n) FILTER (own <> other) AS b FROM pair GROUP BY label, vec_id)
            SELECT CAST(label AS BIGINT) AS label, count(*) AS n,
            round(avg(CASE WHEN own_n = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END), 6) AS silhouette
            FROM ab GROUP BY label HAVING count(*) >= 12""",
        "silhouette_fast": f"""WITH {ASSIGNED}, pts AS (SELECT a.*, vec FROM assigned a JOIN v USING (vec_id)),
            pair AS (SELECT x.label, x.vec_id, x.cluster AS own, y.cluster AS other, sum(pow(list_distance(x.vec, y.vec), 2)) AS s, count(*) AS n
              FROM pts x JOIN pts y ON x.label = y.label GROUP BY ALL),
            ab AS (SELECT label, vec_id, max(n) FILTER (own = other) AS own_n, max(s / nullif(n - 1, 0)) FILTER (own = other) AS a,
              min(s / n) FILTER (own <> other) AS b FROM pair GROUP BY label, vec_id)
            SELECT CAST(label AS BIGINT) AS label, count(*) AS n,
            round(avg(CASE WHEN own_n = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END), 6) AS silhouette_sq
            FROM ab GROUP BY label HAVING count(*) >= 12""",
        "expand_contractions": f"WITH {UTTERANCES} SELECT doc_id, {_unascii(_expand(_PLAIN))} AS expanded FROM utterances",
        "strip_fillers": f"WITH {UTTERANCES} SELECT doc_id, {_unascii(_defill(_PLAIN))} AS stripped FROM utterances",
        "clean_text": f"WITH {CLEANED} SELECT doc_id, cleaned FROM cleaned",
        "parse_structured_prompt": f"""WITH {REPLIES} SELECT task_id, CASE WHEN ok THEN json_extract_string(doc, '$.normalized') ELSE raw END AS normalized,
            CASE WHEN ok THEN json_extract_string(doc, '$.intent') ELSE 'unknown' END AS intent,
            CASE WHEN ok THEN CAST(json_extract_string(doc, '$.confidence_score') AS DOUBLE) ELSE 0.0 END AS confidence,
            CASE WHEN ok THEN json_extract_string(doc, '$.entities.component') END AS component,
            NOT ok AND api_error IS NULL AS parse_failed, api_error FROM parsed""",
        "condition_failures": f"WITH {REPLIES} SELECT task_id, coalesce(api_error, 'malformed JSON') AS reason FROM parsed WHERE NOT ok",
        "conditions_long": f"""WITH {CLEANED}{_PROMPTS} SELECT doc_id, condition, coalesce(plain, json_extract_string(doc, '$.normalized')) AS prompt_text FROM long""",
        "render_prompt": f"""WITH {CLEANED}{_PROMPTS} SELECT doc_id, condition, CASE WHEN condition = 'c' THEN 'Structured developer request (JSON):'
            ELSE 'Developer request:' END || chr(10) || chr(10) || coalesce(plain, doc) AS prompt FROM long""",
        "run_grid": f"WITH {_GRID} SELECT run_id, task_id, model, condition FROM grid",
        "pilot_grid": f"""WITH {_GRID} SELECT run_id, task_id, model, condition FROM grid WHERE model = 'm1'
            AND task_no IN (SELECT task_no FROM tasks ORDER BY task_no LIMIT 5)""",
        "pending_runs": f"WITH {RUNS} SELECT run_id, task_id, model, condition FROM runs WHERE error IS NOT NULL OR topic = 'click'",
        "bucketed_pending": f"WITH {RUNS} SELECT run_id, task_id, model, condition FROM runs WHERE error IS NOT NULL OR topic = 'click'",
        "run_stage_stub": f"""WITH {_GRID}, asked AS (SELECT run_id, 'Developer request:' || chr(10) || chr(10) || topic || ' ' || k AS prompt
              FROM grid JOIN tasks USING (task_id)),
            done AS (SELECT *, contains(prompt, 'error') AS bad,
              'TOOL_CALL: read_file(n=' || length(prompt) || ')' || chr(10) || 'TOOL_CALL: made_up(x)' || chr(10) || 'done' AS txt FROM asked),
            counted AS (SELECT *, CASE WHEN bad THEN 0 ELSE length(prompt) END AS i,
              CASE WHEN bad THEN 0 ELSE len(regexp_extract_all(txt, '\\w+|[^\\w\\s]')) END AS o FROM done)
            SELECT run_id, CASE WHEN NOT bad THEN txt END AS response, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
            CAST(i + o AS BIGINT) AS total_tokens, CASE WHEN bad THEN '[]' ELSE '["read_file"]' END AS tool_sequence,
            CAST(CASE WHEN bad THEN 0 ELSE 2 END AS BIGINT) AS total_tool_calls,
            CASE WHEN bad THEN substr('refused: ' || prompt, 1, 500) END AS error FROM counted""",
        "error_rows": """SELECT doc_id, CAST(NULL AS VARCHAR) AS response, CAST(0 AS BIGINT) AS total_tokens, '[]' AS tool_calls_json,
            substr(coalesce(text, ''), 1, 500) AS error FROM documents""",
        "token_usage": f"""WITH {UTTERANCES} SELECT doc_id, CASE WHEN language = 'en' THEN n_chars
            ELSE CAST(len(regexp_extract_all(utterance, '\\w+|[^\\w\\s]')) AS BIGINT) END AS tokens FROM utterances""",
        "run_status": f"""WITH {RUNS} SELECT model, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed
            FROM runs GROUP BY model""",
        "extract_tool_calls": f"""WITH {RUNS}, ps AS (SELECT run_id, names, regexp_extract_all(response, '{PATTERN}', 2) AS params FROM called),
            flat AS (SELECT run_id, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS tool, unnest(params) AS params FROM ps WHERE len(names) > 0)
            SELECT run_id, CAST(pos AS BIGINT) AS pos, tool, trim(params) AS params, list_contains({_lst(VALID_TOOLS)}, tool) AS valid FROM flat""",
        "valid_calls": f"WITH {RUNS} SELECT run_id, array_to_string(good_names, ',') AS tools FROM named",
        "call_validation": f"""WITH {RUNS} SELECT run_id, CAST(len(names) AS BIGINT) AS total_calls, CAST(len(good_names) AS BIGINT) AS valid_calls,
            CAST(len(bad_names) AS BIGINT) AS invalid_calls, len(names) > 0 AS has_any_tool_call,
            array_to_string(bad_names, ',') AS invalid_tool_names, array_to_string(good_names, ',') AS tool_sequence FROM named""",
        "redundant_calls": f"WITH {RUNS} SELECT run_id, CAST(len(names) - len(list_distinct(names)) AS BIGINT) AS redundant FROM named",
        "tool_halluc_rate": f"""WITH {RUNS} SELECT run_id, CASE WHEN len(names) = 0 THEN 0.0::DOUBLE
            ELSE round(CAST(len(bad_names) AS DOUBLE) / len(names), 6) END AS rate FROM named""",
        "format_compliance": f"""WITH {RUNS} SELECT model, condition, round(avg(CAST(len(names) > 0 AS INT)), 4) AS format_compliance
            FROM named GROUP BY model, condition""",
        "best_sequence_f1": f"""WITH {_SEQ} SELECT run_id, tool_precision, tool_recall, tool_f1, CAST(len(names) AS BIGINT) AS total_tool_calls,
            CAST(len(names) - len(list_distinct(names)) AS BIGINT) AS redundant_calls FROM best JOIN paired USING (run_id)""",
        "first_call_correct": f"WITH {_SEQ} SELECT run_id, first_call_correct FROM best",
        "min_req_met": f"""WITH {_SEQ}, need AS (SELECT run_id, names, unnest(minimum) AS m FROM paired)
            SELECT run_id, CAST(bool_and(list_contains(names, m)) AS BIGINT) AS min_req_met FROM need GROUP BY run_id""",
        "cosine_similarity": f"""WITH {VECTORS} SELECT x.vec_id, round(list_cosine_similarity(x.vec, y.vec), 6) AS cosine
            FROM v x JOIN v y ON y.vec_id = x.vec_id + 1""",
        "intent_preservation": f"""WITH {VECTORS}, g AS (SELECT label, arg_min(vec, vec_id) AS gv FROM v GROUP BY label)
            SELECT vec_id, round(list_cosine_similarity(vec, gv), 6) AS intent_preservation FROM v JOIN g USING (label)""",
        "judge_score_parse": f"""WITH {JUDGE} SELECT task_id, CAST(coalesce(value, 0) AS BIGINT) AS score,
            CASE WHEN reply IS NULL THEN 'no_reply' WHEN span = '' THEN 'no_json' WHEN NOT fine THEN 'bad_json'
              WHEN kind IS NULL THEN 'no_score' WHEN value IS NULL THEN 'bad_score' ELSE 'ok' END AS status FROM vals""",
        "judge_prompts": "SELECT doc_id, " + _JUDGE_TEXT.format(ref="'item ' || source", text="substr(text, 1, 1500)").replace("{{", "{").replace("}}", "}")
            + " AS fidelity_prompt, md5(" + _JUDGE_TEXT.format(ref="source", text="text").replace("{{", "{").replace("}}", "}")
            + ") AS full_prompt_md5 FROM documents",
        "first_code_block": f"""WITH r AS (SELECT conv_id, turn, CASE conv_id % 4
            WHEN 0 THEN 'Here:' || chr(10) || '```Python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || 'more' || chr(10) || '```'
            WHEN 1 THEN '```sql' || chr(10) || '```' || chr(10) || text
            WHEN 2 THEN '  ' || text || ' ```rust' || chr(10) || 'x``` ' || chr(10) ELSE text END AS response FROM conversations)
            SELECT conv_id, turn, coalesce({_code('response')}, '') AS code FROM r""",
        "rule_check": f"WITH {RUNS}{CHECKED} SELECT run_id, functional_correct FROM checks",
        "unscored_runs": f"WITH {_THIN} SELECT run_id FROM thin WHERE topic IN ('view', 'signup')",
        "rescore_selection": f"WITH {RUNS} SELECT run_id FROM runs WHERE error IS NULL AND model = 'm0'",
        "standard_scoring": f"""WITH {SCORED},
            filled AS (SELECT run_id, round(list_cosine_similarity([CAST(planned_calls + 1 AS DOUBLE), CAST(k % 7 AS DOUBLE), 2.0::DOUBLE],
                [CAST(k % 5 AS DOUBLE), 1.0::DOUBLE, CAST(owner % 3 AS DOUBLE)]), 4) AS intent_preservation,
              tool_precision, tool_recall, tool_f1, total_tool_calls, redundant_calls, first_call_correct, min_req_met,
              CAST(planned_calls % 3 AS BIGINT) AS hallucination_score,
              CAST(CASE WHEN topic = 'error' THEN 0 ELSE k % 4 END AS BIGINT) AS intent_fidelity_score, functional_correct
              FROM scored WHERE topic IN ('view', 'signup'))
            SELECT * FROM filled UNION ALL BY NAME
            SELECT run_id, tool_f1, intent_fidelity_score FROM ({_STORED}) WHERE run_id NOT IN (SELECT run_id FROM filled)""",
        "rescore_tools": f"""WITH {SCORED}, stored AS ({_STORED}) SELECT r.run_id, {", ".join(f"b.{c}" for c in (
            "tool_precision", "tool_recall", "total_tool_calls", "redundant_calls", "first_call_correct", "min_req_met"))},
            CASE WHEN b.run_id IS NULL THEN s.tool_f1 ELSE b.tool_f1 END AS tool_f1, s.intent_fidelity_score
            FROM (SELECT run_id FROM runs WHERE error IS NULL) r LEFT JOIN scored b USING (run_id) LEFT JOIN stored s USING (run_id)""",
        "rescore_functional": f"""WITH {RUNS}{CHECKED}, stored AS ({_STORED}) SELECT c.run_id, s.tool_f1, c.functional_correct
            FROM checks c LEFT JOIN stored s USING (run_id)""",
        "rescore_intent": f"""WITH {RUNS}, stored AS ({_STORED}) SELECT r.run_id, s.tool_f1,
            CAST(CASE WHEN r.topic = 'error' THEN 0 ELSE r.k % 4 END AS BIGINT) AS intent_fidelity_score
            FROM runs r LEFT JOIN stored s USING (run_id) WHERE r.error IS NULL""",
        "score_summary": _means(["condition"], {"avg_intent_fidelity": "intent_fidelity_score", "avg_f1": "tool_f1",
                                                "avg_hallucination": "hallucination_score", "avg_tokens": "total_tokens"}),
        "cpstc": f"""WITH {SCORED} SELECT intent, model, condition, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(min_req_met) AS BIGINT) AS successes,
            round(CAST(sum(total_tokens) AS DOUBLE) / nullif(sum(min_req_met), 0), 4) AS cpstc FROM scored GROUP BY ALL""",
        "token_stats": f"""WITH {SCORED} SELECT condition, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
            CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
            round(avg(input_tokens), 1) AS avg_input_tokens, round(avg(output_tokens), 1) AS avg_output_tokens,
            round(avg(input_tokens + output_tokens), 1) AS avg_total_tokens, count(*) FILTER (functional_correct) AS successful_tasks,
            round(CAST(sum(input_tokens + output_tokens) AS DOUBLE) / nullif(count(*) FILTER (functional_correct), 0), 4) AS cpstc
            FROM scored GROUP BY condition""",
        "analysis_base": f"""WITH {SCORED} SELECT run_id, intent, condition, model, total_tokens, execution_time_sec, tool_precision, tool_recall, tool_f1,
            total_tool_calls, redundant_calls, first_call_correct, min_req_met, hallucination_score, intent_fidelity_score, functional_correct FROM scored""",
        "condition_overall": _overall(),
        "stream_last_attempt": f"""WITH {RUNS}, placed AS (SELECT *, instr({HEX}, substr(md5(run_id), 1, 1)) % 3 AS third, error IS NOT NULL AS bad FROM called)
            SELECT model, condition, count(*) AS n,
            CAST(sum(placed.total_tokens + CASE WHEN third = 0 THEN 10 WHEN third = 2 AND bad THEN 5 ELSE 0 END) AS BIGINT) AS total_tokens,
            count(*) FILTER (third = 1 AND bad) AS failed FROM placed GROUP BY model, condition""",
        "result_cube": f"""WITH {SCORED}, flagged AS (SELECT *, CAST(functional_correct AS INT) AS functional_flag FROM scored)
            SELECT model, intent, condition, CAST(GROUPING(model, intent, condition) AS INTEGER) AS level, count(*) AS n,
            {", ".join(f"round(avg(CAST({_OVERALL[n]} AS DOUBLE)), 4) AS {n}" for n in (
                "intent_fidelity", "tool_f1", "hallucination_mean", "first_call_acc", "min_req_met", "format_compliance", "func_correct_rate", "avg_tokens"))},
            round(CAST(sum(total_tokens) AS DOUBLE) / nullif(sum(CAST(flagged.min_req_met AS INT)), 0), 4) AS cpstc
            FROM flagged GROUP BY GROUPING SETS ((condition), (model, condition), (intent, condition), (model), ())""",
        "bucketed_analysis": f"""WITH {SCORED} SELECT model, condition, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens,
            CAST(sum(total_tool_calls) AS BIGINT) AS calls, CAST(sum(redundant_calls) AS BIGINT) AS redundant, round(avg(tool_f1), 4) AS tool_f1
            FROM scored GROUP BY model, condition""",
        "run_frontier": f"""WITH {SCORED}, pts AS (SELECT run_id, intent, total_tokens, round(tool_f1, 4) AS f1 FROM scored WHERE tool_f1 IS NOT NULL AND total_tokens IS NOT NULL),
            tops AS (SELECT intent, total_tokens, max(f1) AS q FROM pts GROUP BY 1, 2),
            ahead AS (SELECT *, max(q) OVER (PARTITION BY intent ORDER BY total_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tops)
            SELECT p.run_id, p.intent, p.total_tokens, p.f1 FROM pts p JOIN ahead a
            ON p.intent = a.intent AND p.total_tokens = a.total_tokens AND p.f1 = a.q WHERE a.prev IS NULL OR a.q > a.prev""",
        "model_stratified": _means(["model", "condition"], {n: _OVERALL[n] for n in (
            "intent_fidelity", "tool_f1", "hallucination_mean", "first_call_acc", "min_req_met", "format_compliance", "func_correct_rate", "avg_tokens")}),
        "model_condition_pivot": _pivot("model", {n: _OVERALL[n] for n in ("func_correct_rate", "hallucination_mean", "intent_fidelity", "tool_f1")}),
        "intent_pivot": _pivot("intent", {"tool_f1": "tool_f1"}),
        "hallucination_deltas": f"""WITH {SCORED}, w AS (SELECT model, {', '.join(f"avg(hallucination_score) FILTER (condition = '{c}') AS {c}" for c in CONDITIONS)}
            FROM scored GROUP BY model) SELECT model, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(c, 4) AS mean_c,
            round(b - a, 4) AS delta_ab, round(c - b, 4) AS delta_bc FROM w""",
        "relative_lift": f"""WITH {SCORED}, scopes AS (SELECT 'all' AS scope, * FROM scored {' '.join(
              f"UNION ALL SELECT 'without_{m}', * FROM scored WHERE model <> '{m}'" for m in MODELS)}),
            w AS (SELECT scope, intent, {', '.join(f"avg(tool_f1) FILTER (condition = '{c}') AS {c}" for c in CONDITIONS)} FROM scopes GROUP BY ALL)
            SELECT scope, intent, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(c, 4) AS mean_c, round(100 * (c / nullif(a, 0) - 1), 4) AS lift_ca_pct,
            round(100 * (c / nullif(b, 0) - 1), 4) AS lift_cb_pct FROM w""",
        "describe_metric": f"""WITH {SCORED}, s AS (SELECT condition, avg(tool_f1) AS m, stddev_samp(tool_f1) AS sd, quantile_cont(tool_f1, 0.5) AS q,
              min(tool_f1) AS lo, max(tool_f1) AS hi, count(*) AS n FROM scored GROUP BY condition)
            SELECT condition, round(m, 4) AS mean, round(sd, 4) AS std, round(q, 4) AS median, round(lo, 4) AS min, round(hi, 4) AS max, n,
            round(m - {_t_crit('(n - 1)')} * sd / sqrt(n), 4) AS ci_lower, round(m + {_t_crit('(n - 1)')} * sd / sqrt(n), 4) AS ci_upper FROM s""",
        "kendall_tau": f"WITH {_SEQ}{TAUS} SELECT run_id, round(tau, 6) AS tau FROM taus",
        "cohens_kappa": """WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM r),
            e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) AS pe FROM (SELECT a, count(*) AS n FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY b) y ON x.a = y.b)
            SELECT n, agree, round((CAST(agree AS DOUBLE) / n - pe / n / n) / (1 - pe / n / n), 4) AS kappa FROM t, e""",
        "document_rank_agreement": """WITH v AS (SELECT length(text) AS x, length(text) - length(replace(text, ' ', '')) AS y FROM documents WHERE text IS NOT NULL),
            c AS (SELECT x, y, count(*) AS w FROM v GROUP BY ALL), t AS (SELECT count(*) AS n FROM v),
            tx AS (SELECT sum(w * (w - 1) // 2) AS k FROM (SELECT count(*) AS w FROM v GROUP BY x)),
            ty AS (SELECT sum(w * (w - 1) // 2) AS k FROM (SELECT count(*) AS w FROM v GROUP BY y)),
            s AS (SELECT sum(p.w * q.w * sign(q.y - p.y)) AS k FROM c p JOIN c q ON p.x < q.x)
            SELECT n, CAST(tx.k AS BIGINT) AS ties_x, CAST(ty.k AS BIGINT) AS ties_y, CAST(s.k AS BIGINT) AS surplus,
                round(s.k / (sqrt(n * (n - 1) / 2 - tx.k) * sqrt(n * (n - 1) / 2 - ty.k)), 6) AS tau_b FROM t, tx, ty, s""",
        "paired_ttest": _ttest(),
        "cohens_d": f"""WITH {SCORED}, s AS (SELECT condition, count(*) AS n, avg(tool_f1) AS m, var_samp(tool_f1) AS v FROM scored GROUP BY condition),
            j AS (SELECT x.condition AS f, y.condition AS s, y.n AS n1, y.m AS m1, y.v AS v1, x.n AS n2, x.m AS m2, x.v AS v2 FROM s x JOIN s y
              ON x.condition < y.condition) SELECT f AS "first", s AS "second", {_D_OF} AS d FROM j""",
        "mean_ci95": f"""WITH {SCORED}, s AS (SELECT model, condition, avg(tool_f1) AS m, stddev_samp(tool_f1) AS sd, count(*) AS n FROM scored GROUP BY ALL)
            SELECT model, condition, n, round(m, 4) AS mean, round(m - {_t_crit('(n - 1)')} * sd / sqrt(n), 4) AS ci_lower,
            round(m + {_t_crit('(n - 1)')} * sd / sqrt(n), 4) AS ci_upper FROM s""",
        "anova_by_intent": _anova("intent", "condition", 3),
        "anova_models": _anova("", "model", None),
        "anova_two_way": _two_way(),
        "tukey_q": f"""WITH {SCORED}, s AS (SELECT model, count(*) AS n, avg(tool_f1) AS m, var_samp(tool_f1) AS v FROM scored GROUP BY model),
            e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM s)
            SELECT x.model AS "first", y.model AS "second", round(y.m - x.m, 4) AS mean_diff,
            round(abs(y.m - x.m) / sqrt(mse / 2 * (1.0 / x.n + 1.0 / y.n)), 4) AS q FROM s x JOIN s y ON x.model < y.model, e""",
        "tukey_hsd": _HSD,
        "rule_check_many": _PHRASES,
        "mcnemar_exact": _mcnemar("min_req_met", "a", "c"),
        "mcnemar_hallucination": _mcnemar("CAST(hallucination_score = 0 AS INT)", "b", "c"),
        "failure_taxonomy": f"""WITH {RUNS}, j AS (SELECT n.*, minimum FROM named n JOIN gold USING (task_id)),
            o AS (SELECT condition, CASE WHEN error IS NOT NULL THEN 'error' WHEN len(names) = 0 THEN 'no_call' WHEN len(bad_names) > 0 THEN 'invalid_name'
              WHEN NOT list_has_all(names, minimum) THEN 'minimum_not_met' ELSE 'success' END AS outcome FROM j)
            SELECT condition, outcome, count(*) AS n FROM o GROUP BY ALL""",
        "bootstrap_poisson": f"WITH {SCORED}{_boot_ratio()} SELECT condition, round(ci_lower, 4) AS ci_lower, round(ci_upper, 4) AS ci_upper FROM bounds",
        "bootstrap_mean": f"""WITH {SCORED}{_boot_mean(['model', 'condition'], 'scored', 'tool_f1')}
            SELECT model, condition, round(ci_lower, 4) AS ci_lower, round(ci_upper, 4) AS ci_upper FROM bounds""",
        "fig_mean_ci": _fig_mean(["metric", "condition"], "val", "long", SCORED + """, long AS (
            SELECT 'intent_fidelity_score' AS metric, condition, CAST(intent_fidelity_score AS DOUBLE) AS val FROM scored
            UNION ALL SELECT 'tool_f1', condition, tool_f1 FROM scored
            UNION ALL SELECT 'kendall_tau', condition, kendall_tau FROM scored WHERE kendall_tau IS NOT NULL)"""),
        "fig_precision_recall": _means(["condition"], {"precision": "tool_precision", "recall": "tool_recall"}),
        "fig_model_f1": _fig_mean(["model", "condition"], "tool_f1"),
        "fig_intent_f1": _means(["intent", "condition"], {"mean_f1": "tool_f1"}),
        "fig_token_scatter": f"WITH {SCORED} SELECT run_id, condition, total_tokens, tool_f1 FROM scored",
        "fig_redundancy_success": _means(["condition"], {"redundant": "redundant_calls", "success": "min_req_met"}),
        "fig_hallucination": _pivot("model", {"hallucination": "hallucination_score"}),
        "fig_pareto": f"""WITH {SCORED}{_boot_ratio()}, pts AS (SELECT condition, CAST(sum(total_tokens) AS DOUBLE) / nullif(sum(min_req_met), 0) AS x,
              avg(tool_f1) AS y FROM scored GROUP BY condition)
            SELECT p.condition, round(x, 4) AS cpstc, round(y, 4) AS mean_f1, round(x - ci_lower, 4) AS err_low, round(ci_upper - x, 4) AS err_high,
            NOT EXISTS (SELECT 1 FROM pts o WHERE o.x <= p.x AND o.y >= p.y AND (o.x < p.x OR o.y > p.y)) AS on_frontier
            FROM pts p LEFT JOIN bounds USING (condition)""",
        "fig_latency": _fig_mean(["model", "condition"], "execution_time_sec"),
        "fig_success": _means(["condition"], {"first_call": "first_call_correct", "eventual": "min_req_met"}),
        "fig_fidelity_model": _fig_mean(["model", "condition"], "intent_fidelity_score"),
        "fig_tokens": _means(["condition"], {"input": "input_tokens", "output": "output_tokens"}),
        "fig_compliance": _fig_mean(["model", "condition"], "format_compliance"),
        "stream_scoring": f"""WITH {SCORED} SELECT run_id, condition, tool_f1, min_req_met, total_tokens FROM scored""",
        "stream_summary": f"""WITH {SCORED} SELECT condition, count(*) AS n, round(avg(intent_fidelity_score), 4) AS avg_intent_fidelity,
            round(avg(tool_f1), 4) AS avg_f1, round(avg(hallucination_score), 4) AS avg_hallucination,
            round(avg(total_tokens), 4) AS avg_tokens FROM scored GROUP BY condition""",
    }
