"""Registered queries of the corpus operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialmill.llm import (
    decontam, htmltext, hyperminhash, licenses, mixing, quality, repair, retraction, sharding, simhash, substrings, topk, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SHARDS = 64


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pareto_mix(spark, sf_dir):
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_lookup_shards(spark, sf_dir):
    placed = sharding.place(table(spark, sf_dir, "documents"), sharding.shard_names(SHARDS))
    return placed.select("doc_id", "slot", "shard")


@query
def op3_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


@query
def op4_string_tiling(spark, sf_dir):
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "tiles")


@query
def op5_histogram_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op6_consensus_html(spark, sf_dir):
    return htmltext.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_license_index(spark, sf_dir):
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op8_toxic_convolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


@query
def op9_covering_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_window_dedup(spark, sf_dir):
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op11_structure_repair(spark, sf_dir):
    return repair.digest(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


@query
def op12_hyperminhash(spark, sf_dir):
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_filter_audit(spark, sf_dir):
    return retraction.filter_orders(retraction.mask_counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS amount,
         coalesce(sum(2 * source_size) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS gone, sum(w) OVER () AS everyone
  FROM totals
  WINDOW before AS (ORDER BY (2 * source_size) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, (amount - CAST(caps AS DOUBLE)) / CAST(everyone - gone AS DOUBLE) AS lv FROM levels),
chosen AS (SELECT max(lv) AS lv FROM leveled WHERE lv * w <= 2 * source_size),
targets AS (
  SELECT source, source_size, n_docs,
         coalesce(least(CAST(2 * source_size AS DOUBLE), chosen.lv * w), CAST(2 * source_size AS DOUBLE)) AS target
  FROM leveled, chosen),
classed AS (
  SELECT s.*, t.source_size, t.n_docs, t.target,
         CASE WHEN s.size * n_docs <= source_size THEN 4 WHEN s.size * n_docs <= 4 * source_size THEN 3
              WHEN s.size * n_docs <= 16 * source_size THEN 2 ELSE 1 END AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
classes AS (
  SELECT source, k, any_value(floor(target + 0.5)) AS goal, CAST(sum(size) AS BIGINT) AS words
  FROM classed GROUP BY source, k),
class_levels AS (
  SELECT *, (goal - CAST(coalesce(sum(2 * words) OVER before, 0) AS DOUBLE))
            / CAST(sum(words * k) OVER (PARTITION BY source) - coalesce(sum(words * k) OVER before, 0) AS DOUBLE) AS lv
  FROM classes WHERE words > 0
  WINDOW before AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
class_copies AS (
  SELECT *, coalesce(least(2::DOUBLE, max(CASE WHEN lv * (words * k) <= 2 * words THEN lv END) OVER (PARTITION BY source) * k), 2::DOUBLE) AS copies
  FROM class_levels),
parts AS (
  SELECT *, floor(copies) AS certain, copies - floor(copies) AS inclusion,
         goal - sum(floor(copies) * words) OVER (PARTITION BY source) AS "left"
  FROM class_copies),
keyed AS (
  SELECT c.*, p.certain, p.inclusion, p."left",
         CASE WHEN inclusion > 0 AND size > 0 THEN (u / (1 - u)) / (inclusion / (1 - inclusion)) END AS q
  FROM classed c LEFT JOIN parts p ON c.source IS NOT DISTINCT FROM p.source AND c.k = p.k),
running AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST) AS upto,
         sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source, q) AS together
  FROM keyed)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE certain * size +
         CASE WHEN q IS NULL OR "left" <= 0 THEN 0 WHEN upto <= "left" THEN size WHEN upto - together >= "left" THEN 0
              ELSE floor(("left" - (upto - together)) * size / together) END END AS BIGINT) AS taken
FROM running
"""

OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""

OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM starts),
repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
marked AS (
  SELECT p.doc_id, p.i, p.word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM places p LEFT JOIN repeated r ON p.doc_id = r.doc_id AND p.i = r.i),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM marked WHERE last IS NULL OR i >= last + 20 GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), md5(text), copy) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS bigram
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (bigram NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id),
chart AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0::BIGINT, 'a': ''} AS c0, {'c': 1000000000::BIGINT, 'a': ''} AS c1,
         {'c': 5::BIGINT, 'a': 'I'} AS c2, {'c': 10::BIGINT, 'a': 'II'} AS c3
  FROM counts
  UNION ALL
  SELECT conv_id, i, c0, c1, n2, list_min([n3, {'c': n2.c + 5, 'a': n2.a || 'I'}])
  FROM (
    SELECT conv_id, i, c0, c1, n3,
           list_min([n2, {'c': c0.c + 5, 'a': c0.a || 'I'}, {'c': c1.c + 5, 'a': c1.a || 'I'}, {'c': n3.c + 5, 'a': n3.a || 'I'}]) AS n2
    FROM (
      SELECT t.conv_id, t.i, {'c': r.c0.c + 2, 'a': r.c0.a || 'D'} AS c0,
             list_min([{'c': r.c1.c + 2, 'a': r.c1.a || 'D'}, {'c': r.c0.c + CASE WHEN initial = 's' THEN e ELSE 1000000000 END, 'a': r.c0.a || 'K'}]) AS c1,
             list_min([{'c': r.c2.c + 2, 'a': r.c2.a || 'D'},
                       list_min([{'c': r.c0.c + uc, 'a': r.c0.a || ul}, {'c': r.c1.c + uc, 'a': r.c1.a || ul}, {'c': r.c3.c + uc, 'a': r.c3.a || ul}])]) AS n2,
             list_min([{'c': r.c3.c + 2, 'a': r.c3.a || 'D'}, {'c': r.c2.c + ac, 'a': r.c2.a || al}]) AS n3
      FROM chart r JOIN (
        SELECT conv_id, i, initial, e, CASE WHEN initial = 'u' THEN e ELSE e + 1 END AS uc, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS ul,
               CASE WHEN initial = 'a' THEN e ELSE e + 1 END AS ac, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS al
        FROM (SELECT *, CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END AS e FROM faulty)) t
      ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = r.i + 1))),
best AS (
  SELECT c.conv_id, list_min([r.c0, r.c3]) AS b, c.* EXCLUDE (conv_id)
  FROM counts c JOIN chart r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.i),
letters AS (
  SELECT conv_id, unnest(range(1, len(b.a) + 1)) AS pos, unnest(string_split(b.a, '')) AS edit FROM best WHERE b.a <> ''),
counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS k
  FROM letters),
filled AS (
  SELECT l.conv_id, l.pos, l.edit, l.k, CASE WHEN edit <> 'I' THEN f.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, f.initial,
         max(CASE WHEN l.k = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM counted l LEFT JOIN faulty f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS h
  FROM filled GROUP BY conv_id)
SELECT o.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

OP12_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS UBIGINT[]) ELSE list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - 1, 2)), lambda i: hash(array_to_string(list_slice(w, i, i + 2), ' '))))) END AS s
  FROM split),
points AS (SELECT s, row_number() OVER () AS p FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT p, len(s) AS n, unnest(s) AS g FROM points),
ranked AS (SELECT p, n, g, row_number() OVER (PARTITION BY p ORDER BY f, g) AS r FROM grams JOIN (SELECT g, count(*) AS f FROM grams GROUP BY g) USING (g)),
-- of two alike sets one holds one of the other's rarest n - ceil(0.85 n) + 1 shingles
rare AS (SELECT * FROM ranked WHERE r <= n - (85 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.p AS a, b.p AS b FROM rare a JOIN rare b ON a.g = b.g AND a.p < b.p AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT a, b, len(x.s) AS na, len(y.s) AS nb, len(list_intersect(x.s, y.s)) AS i FROM met JOIN points x ON x.p = a JOIN points y ON y.p = b)
  WHERE 100 * i >= 85 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT p AS a, p AS b FROM points
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
owners AS (SELECT p, min(doc_id) AS least FROM points JOIN sets USING (s) GROUP BY p),
components AS (SELECT a AS p, min(least) AS component_id FROM reach JOIN owners ON b = p GROUP BY a)
SELECT doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id,
       doc_id = coalesce(c.component_id, doc_id) AS kept
FROM sets x LEFT JOIN points USING (s) LEFT JOIN components c USING (p)
"""

OP13_SQL = r"""
WITH labelled AS (
  SELECT doc_id AS lid, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e
  FROM docs LEFT JOIN labelled ON doc_id = lid),
masks AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM judged GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
perms AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM masks, steps GROUP BY part, filter_order, step
"""


def statements() -> dict[str, str]:
    return {
        "op1_pareto_mix": OP1_SQL, "op5_histogram_topk": OP5_SQL, "op10_window_dedup": OP10_SQL,
        "op11_structure_repair": OP11_SQL, "op12_hyperminhash": OP12_SQL, "op13_filter_audit": OP13_SQL,
    }
