"""Task sampling: entity richness, representatives, ids, gold joins, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip, word_count, zero_padded
from ..session import large_side, small_side

ENTITY_COLUMNS = ("language", "framework", "error_type")


def _present(value: Column) -> Column:
    return F.coalesce(~strip(value.cast("string")).isin("", "nan"), F.lit(False))


def clean_entity(value: Column) -> Column:
    """NULL, blank and the text `nan` all mean: no entity."""
    return F.when(_present(value), value)


def entity_richness(columns=ENTITY_COLUMNS) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + _present(F.col(name)).cast("int")
    return total.cast("long")


def intent_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("intent").agg(F.count("*").alias("n"))


def corpus_profile(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    counted = df.withColumn("_words", word_count(F.col(text)))
    coverage = [F.round(100 * F.avg(_present(F.col(c)).cast("int")), 4).alias(f"{c}_pct") for c in ENTITY_COLUMNS]
    return counted.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg("_words"), 4).alias("words_mean"),
        F.min("_words").alias("words_min"),
        F.max("_words").alias("words_max"),
        F.round(F.stddev_samp("_words"), 4).alias("words_std"),
        *coverage,
    )


def cluster_representatives(points: DataFrame, keys: list[str], distance: str, richness: str, order: str) -> DataFrame:
    """One point per cluster: nearest to the centroid, ties by richness, then input order.

    Distances tie within 1e-6 plus 1e-5 of the minimum.  Both passes are aggregates that
    combine before the shuffle, so a cluster holding most points stays spread out.
    """
    nearest = points.groupBy(*keys).agg(F.min(distance).alias("_min"))
    tied = points.join(small_side(nearest), keys).filter(
        F.abs(F.col(distance) - F.col("_min")) <= 1e-6 + 1e-5 * F.col("_min"))
    rest = [c for c in points.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(richness)).alias("a"), F.col(order).alias("b"))).alias("_row")
    return tied.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def task_ids(selected: DataFrame, label: str, order: list[str]) -> DataFrame:
    """`label_001`, `label_002`, … in the given order.

    `selected` holds a few representatives per class, so the window is small.
    """
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return selected.withColumn("task_id", F.concat(F.col(label).cast("string"), F.lit("_"),
                                                   zero_padded(rank, 3)))


def small_class_fallback(df: DataFrame, label: str, order: str, clusters: int) -> DataFrame:
    """Classes too small to cluster (fewer than two rows or clusters): their first row, as cluster 0.

    An aggregate, so that with one cluster no class is ranked whole in one task.
    """
    rest = [c for c in df.columns if c != label]
    first = df.groupBy(label).agg(
        F.count("*").alias("_n"), F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    picked = first.filter((F.col("_n") < 2) | (F.lit(clusters) == 1)).filter(F.lit(clusters) > 0)
    return picked.select(label, *[F.col(f"_row.{c}").alias(c) for c in rest], F.lit(0).alias("cluster"))


def raw_task(df: DataFrame) -> DataFrame:
    """Task record with its entities nested and cleaned."""
    entities = F.struct(*[clean_entity(F.col(c)).alias(c) for c in ENTITY_COLUMNS])
    return df.withColumn("entities_in_source", entities).drop(*ENTITY_COLUMNS)


def append_composites(selected: DataFrame, composites: DataFrame) -> DataFrame:
    """Sampled tasks followed by hand-written ones, which carry other columns."""
    return selected.withColumn("source", F.lit("dataset_sampled")).unionByName(
        composites.withColumn("source", F.lit("manually_authored")), allowMissingColumns=True)


def merge_gold(*parts: DataFrame) -> DataFrame:
    """Gold tables merged by task; a later part replaces an earlier one."""
    from .tables import keep_last

    stacked = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], start=1):
        stacked = stacked.unionByName(part.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    return keep_last(stacked, ["task_id"], ["_part"]).drop("_part")


def tasks_master(tasks: DataFrame, gold: DataFrame) -> DataFrame:
    """Tasks with their gold standard nested; tasks without one are left out."""
    top = ["has_unit_test", "unit_test_path"]
    nested = [c for c in gold.columns if c not in ("task_id", *top)]
    packed = gold.select("task_id", F.struct(*nested).alias("gold_standard"), *[c for c in top if c in gold.columns])
    return tasks.join(large_side(packed), "task_id")


def missing_gold(tasks: DataFrame, gold: DataFrame) -> DataFrame:
    return tasks.join(large_side(gold.select("task_id")), "task_id", "left_anti")


def quality_report(master: DataFrame, text: str, embedding: str | None = None) -> DataFrame:
    """Counts behind the data checks, as one row; `embedding` names the gold vector, where there is one.

    Duplicates are found by counting per key, which reduces before the shuffle; a plain
    count-distinct over two columns would copy every row per column.
    """
    def repeats(column: str, name: str) -> DataFrame:
        per_key = master.groupBy(column).agg(F.count("*").alias("_n"))
        return per_key.agg(F.count_if(F.col("_n") > 1).alias(name), F.count("*").alias(f"distinct_{column}"))

    whole = master.agg(
        F.count("*").alias("n_tasks"),
        F.count_if(F.coalesce(F.size("gold_standard.expected_tools"), F.lit(0)) < 1).alias("empty_expected"),
        F.count_if(F.coalesce(F.size("gold_standard.minimum_required_tools"), F.lit(0)) < 1).alias("empty_minimum"),
        *([F.count_if(F.coalesce(F.size(embedding), F.lit(0)) < 1).alias("empty_embeddings")] if embedding else []),
        F.count_if("has_unit_test").alias("with_tests"),
        F.count_if(~F.col("has_unit_test")).alias("without_tests"),
    )
    # Three one-row frames, stacked and folded into one.
    stacked = whole
    for part in (repeats("task_id", "repeated_ids"), repeats(text, "repeated_texts")):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def assert_quality(report: DataFrame, expected_rows: int | None = None) -> None:
    row = report.first()
    problems = [name for name in ("repeated_ids", "repeated_texts", "empty_expected", "empty_minimum", "empty_embeddings")
                if name in report.columns and row[name]]
    if expected_rows is not None and row["n_tasks"] != expected_rows:
        problems.append(f"n_tasks={row['n_tasks']}, expected {expected_rows}")
    if problems:
        raise ValueError("task checks failed: " + ", ".join(problems))
