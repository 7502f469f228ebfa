"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words.  Each document gets an expected number of copies that
depends on its source and on its length class; the whole part is certain, the fraction is the
probability of one copy more.  Those copies are drawn in Pareto order: a random number's odds over
the inclusion odds, smallest first, until the source's remainder is full.  The document at the
border gives only the words that are still missing, so a source meets its target to the word.

Orders are never sorted whole: words are summed in 4096 x 4096 slices of the key, and only the one
slice that holds the border is looked at row by row.

Defined cases: a null text or one without words has size 0 and takes nothing; a null source is a
source of its own, after all others; rows without doc_id draw by their text; repeated rows draw the
same number and share what the border leaves in proportion to their size; an empty table gives an
empty mix.  Columns that clash with the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialmill.llm.common import WORD, cut_lineage, fresh, id_hash, join_written, shielded

SLICES = 4096
#: Inclusion weight by length: up to the mean of the source, up to 4 times it, up to 16 times it, beyond.
LENGTH_WEIGHTS = (4, 3, 2, 1)


def water_fill(rows: DataFrame, by: list[str], amount: str, weight: str, cap: str, order: list[Column]) -> DataFrame:
    """Share `amount` by `weight` within `by`; what exceeds `cap` goes to the others by weight.

    Rows sorted by cap over weight fill up in that order.  The level rises while rows are full and falls
    after the first that is not, so one pass of running sums finds it as a maximum.  Adds `level`: a row's share is least(cap, level * weight).
    """
    ordered = Window.partitionBy(*by).orderBy(F.try_divide(F.col(cap), F.col(weight)).asc(), *order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    return (
        rows.withColumn("_caps", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .withColumn("_all", F.sum(weight).over(group))
        .withColumn("_level", F.try_divide(F.col(amount) - F.col("_caps"), F.col("_all") - F.col("_gone")))
        .withColumn("level", F.max(F.when(F.col("_level") * F.col(weight) <= F.col(cap), F.col("_level"))).over(group))
        .drop("_caps", "_gone", "_all", "_level")
    )


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """(source, source_size, n_docs) with `target`: `share` of all words, by weight, capped."""
    everything = Window.partitionBy()
    ranked = totals.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    given = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    rows = (
        ranked.withColumn("_weight", given)
        .withColumn("_cap", F.col("source_size") * max_copies)
        .withColumn("_amount", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    filled = water_fill(rows, [], "_amount", "_weight", "_cap", [F.col("_i").asc()])
    # all capped: no level is left
    target = F.coalesce(F.least(F.col("_cap").cast("double"), F.col("level") * F.col("_weight")), F.col("_cap").cast("double"))
    return filled.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def _length_weight(size: Column, n_docs: Column, source_size: Column) -> Column:
    words = size * n_docs
    a, b, c, d = (F.lit(w).cast("long") for w in LENGTH_WEIGHTS)
    return F.when(words <= source_size, a).when(words <= 4 * source_size, b).when(words <= 16 * source_size, c).otherwise(d)


def _pareto_key(u: Column, inclusion: Column) -> Column:
    return (u / (F.lit(1.0) - u)) / (inclusion / (F.lit(1.0) - inclusion))


def _border(rows: DataFrame, slice_of: Column, start: Column) -> DataFrame:
    """Per source: the slice in which the running sum of words reaches `left`, and the words before it."""
    sums = rows.groupBy("source", slice_of.alias("_slice")).agg(
        F.sum("size").alias("_words"), F.first("left").alias("left"), F.first(start).alias("_start")
    )
    ordered = Window.partitionBy("source").orderBy("_slice")
    running = sums.withColumn("_upto", F.col("_start") + F.sum("_words").over(ordered))
    found = running.where((F.col("_upto") >= F.col("left")) & (F.col("_upto") - F.col("_words") < F.col("left")))
    return found.select(F.col("source").alias("_s"), F.col("_slice"), (F.col("_upto") - F.col("_words")).alias("_before"), "_words")


def plan(docs: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """Per source and length class: target, certain copies, inclusion probability and border of the order.

    `docs` has source, size and u.  The result has at most four rows a source.
    """
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = cut_lineage(source_targets(totals, weights, share, max_copies))
    known = join_written(docs, targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumn("weight", _length_weight(F.col("size"), F.col("n_docs"), F.col("source_size")))
    classes = (
        known.groupBy("source", "weight", "source_size", "n_docs", "target").agg(F.sum("size").alias("words"))
        .withColumn("_goal", F.floor(F.col("target") + 0.5))
        .withColumn("_mass", F.col("words") * F.col("weight"))
        .withColumn("_cap", F.col("words") * max_copies)
    )
    filled = water_fill(classes, ["source"], "_goal", "_mass", "_cap", [F.col("weight").desc()])
    copies = F.coalesce(F.least(F.lit(float(max_copies)), F.col("level") * F.col("weight")), F.lit(float(max_copies)))
    by_class = (
        filled.withColumn("_copies", copies)
        .withColumn("certain", F.floor("_copies"))
        .withColumn("inclusion", F.col("_copies") - F.col("certain"))
        .withColumn("left", F.col("_goal") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source")))
        .select("source", "weight", "source_size", "n_docs", "target", "certain", "inclusion", "left")
    )
    by_class = cut_lineage(by_class)
    drawn = (
        join_written(
            known.select("source", "size", "u", "weight"),
            by_class.select(F.col("source").alias("_s"), F.col("weight").alias("_w"), "inclusion", "left"),
            F.col("source").eqNullSafe(F.col("_s")) & (F.col("weight") == F.col("_w")),
        )
        .where((F.col("inclusion") > 0) & (F.col("size") > 0) & (F.col("left") > 0))
        .withColumn("q", _pareto_key(F.col("u"), F.col("inclusion")))
        .select("source", "size", "left", "q")
    )
    place = F.col("q") / (F.lit(1.0) + F.col("q")) * SLICES
    coarse = cut_lineage(_border(drawn, F.floor(place), F.lit(0).cast("long")))
    inside = (
        join_written(drawn, coarse.drop("_words"), F.col("source").eqNullSafe(F.col("_s")) & (F.floor(place) == F.col("_slice")))
        .select("source", "size", "left", "q", F.col("_before").alias("_first"))
    )
    fine_place = F.floor((place - F.floor(place)) * SLICES)
    fine = cut_lineage(_border(inside, fine_place, F.col("_first")))
    last = (
        join_written(inside.drop("_first"), fine.drop("_words"), F.col("source").eqNullSafe(F.col("_s")) & (fine_place == F.col("_slice")))
        .select("source", "size", "left", "q", F.col("_before").alias("_first"))
    )
    border = _border(last, F.col("q"), F.col("_first")).select(
        "_s", F.col("_slice").alias("border"), F.col("_before").alias("border_before"), F.col("_words").alias("border_words")
    )
    return by_class.join(border, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


@shielded("doc_id", "text", "source")
def pareto_mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """`docs` (doc_id, text, source, ...) with size, source_size, target and taken (words the mix takes).

    Sources in code point order get `weights`, repeating.  `share` is the mix's size over all words;
    no document gives more than `max_copies` times its words.  Reruns draw the same mix.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "u")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "u", (id_hash(F.col("doc_id"), F.col("text"), seed) + F.lit(0.5)) / F.lit(float(2**52))
    )
    slim = cut_lineage(sized.select("source", "size", "u"))
    planned = cut_lineage(plan(slim, weights, share, max_copies))
    renamed = planned.select(
        F.col("source").alias("_s"), F.col("weight").alias("_w"), "source_size", "target", "n_docs",
        *[F.col(c).alias(f"_{c}") for c in ("certain", "inclusion", "left", "border", "border_before", "border_words")],
    )
    means = cut_lineage(renamed.groupBy("_s", "source_size", "n_docs", "target").agg(
        F.map_from_entries(F.collect_list(F.struct("_w", F.struct("_certain", "_inclusion", "_left", "_border", "_border_before", "_border_words")))).alias("_classes")
    ))
    rows = join_written(sized, means, F.col("source").eqNullSafe(F.col("_s")), "left")
    mine = F.element_at(F.col("_classes"), _length_weight(F.col("size"), F.col("n_docs"), F.col("source_size")))
    rows = rows.withColumn("_mine", mine)
    q = F.when(F.col("_mine._inclusion") > 0, _pareto_key(F.col("u"), F.col("_mine._inclusion")))
    extra = (
        F.when(q.isNull() | (F.col("_mine._left") <= 0), F.lit(0))
        .when(F.col("_mine._border").isNull() | (q < F.col("_mine._border")), F.col("size"))
        .when(
            q == F.col("_mine._border"),
            F.floor((F.col("_mine._left") - F.col("_mine._border_before")) * F.col("size") / F.col("_mine._border_words")),
        )
        .otherwise(F.lit(0))
    )
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_mine._certain") * F.col("size") + extra).cast("long")
    return rows.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix as documents: a row for each whole copy; the border document comes in whole if at least half of it is due."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    copy = fresh(mixed, "_copy")
    repeated = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies >= 1)
    return repeated.drop(copy, "size", "source_size", "target", "taken")
