"""Keyed-table maintenance: schema evolution, upserts, column-group updates, snapshots."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage, large_side, shared_dir

BUCKETS = 64


def evolve(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add the columns of `schema` that `df` lacks, as typed NULLs; keep what is there."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    present = set(df.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in present}
    return df.withColumns(missing) if missing else df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at `path`, or an empty one on first use."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return evolve(spark.read.option("mergeSchema", "true").parquet(path), schema)
    return spark.createDataFrame([], schema)


def keep_last(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One whole row per key, the one with the greatest version.

    An aggregate rather than a window: rows of a key that was retried very often are
    reduced before the shuffle and never gather in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], version: str, dealt_by: str | None = None) -> DataFrame:
    """Replace or insert whole rows; within `incoming` the greatest version wins, and any
    incoming row beats the stored one.

    Only `incoming` is reduced; stored rows are dropped where a new one has their key.  `dealt_by` names a column that
    the keys fix and that is never NULL: a stored table that is dealt by it stays where it is.
    """
    place = [dealt_by] if dealt_by else []
    latest = cut_lineage(keep_last(incoming, [*place, *keys], [version]))
    replaced = latest.select(*[F.col(k).alias(f"_{k}") for k in [*place, *keys]])
    # Null-safe keys are compared as formulas, which no dealt column matches; the plain comparison does.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], *[F.col(k) == F.col(f"_{k}") for k in place])
    return table.join(large_side(replaced), same, "left_anti").unionByName(latest, allowMissingColumns=True)


def key_columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def partial_update(table: DataFrame, updates: DataFrame, key: str | list[str], columns: list[str],
                   version: str | None = None) -> DataFrame:
    """Set only `columns` where the key matches; an update may write NULL.

    Of several updates of a key the one with the greatest `version` counts, without a version the
    greatest values.
    """
    values = F.struct(*columns)
    keys = key_columns(key)
    new = updates.groupBy(*keys).agg((F.max_by(values, F.col(version)) if version else F.max(values)).alias("_new"))
    joined = table.join(large_side(new), keys, "left")
    changed = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).drop("_new").select(*table.columns)


def ensure_keys(table: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Give every key a row; new rows hold NULL everywhere else."""
    names = key_columns(key)
    absent = keys.select(*names).join(large_side(table.select(*names)), names, "left_anti").distinct()
    return table.unionByName(absent, allowMissingColumns=True)


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """`df` stored in `buckets` by `key`, a sorted file each, and read back as such.

    Tables stored with one number of buckets join, anti-join and aggregate on the key without a shuffle:
    a run log and its scores pay for the shuffle once, when they are written.
    """
    spark, name = df.sparkSession, f"trialmill_bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def snapshot_once(df: DataFrame, path: str) -> None:
    """Copy the table aside unless a snapshot is already there."""
    df.write.mode("ignore").parquet(path)


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.filter(F.col(key).isin(values))
