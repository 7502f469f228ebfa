"""Session set-up and the few physical-plan helpers the operators share."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024
#: Stored bytes of a table that one task gets where each of its rows becomes many.
SHARE_BYTES = 1024 * 1024


def build_session(app: str = "trialmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    Only on one machine (a local master, as in tests) a session may name none; a temporary folder
    is made then.  A cluster without a shared folder is refused: executors would write to their own
    disks and read back missing rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="trialmill-")
    return _OWN_FOLDERS[app]


_SCOPES: list[list[str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table into the shared folder and read it back.

    One computation (a checkpoint would run the plan twice), it survives lost executors, and
    the written size lets Catalyst choose joins.  The table goes with the innermost `scratch` around
    the call, by `forget`, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trialmill-cut-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def _folder(spark: SparkSession, path: str):
    """Hadoop's path and file system of a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder, files = _folder(spark, path)
        files.delete(folder, True)


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that `cut_lineage` wrote and nothing reads any more; other frames are left alone."""
    for table in tables:
        if path := getattr(table, "written_at", None) if table is not None else None:
            remove_folders(table.sparkSession, [path])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what `cut_lineage` wrote in this block when it ends: its result must be stored by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove_folders(spark, _SCOPES.pop())


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; needs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast for a table with few rows by construction (a row per class, cluster or rule).

    Catalyst's estimate of an aggregate grows with its input, so above `limit` the table is written
    and its files are measured.  What is still larger is returned without a hint: the join shuffles
    and AQE splits hot keys.  Sides that grow with the data get no hint at all.
    """
    if planned_bytes(df) > limit:
        df = cut_lineage(df)
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def large_side(df: DataFrame) -> DataFrame:
    """Keep a table that grows with the data out of broadcasts.

    Estimates start from compressed files and do not know how many rows an explode makes, so a table of many
    hundred MB can pass for one below the broadcast limit and fill the driver.  A sort-merge join may spill.
    """
    return df.hint("merge")


def shares(table: DataFrame, share: int = SHARE_BYTES) -> int:
    """Number of tasks that get about `share` stored bytes of a table each, one a core at least."""
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(planned_bytes(table) / share))


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input whose scan has fewer splits than there are cores.

    What arrives in as many splits as there are cores, whatever its size, passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Work the named columns out once a row.

    Catalyst would otherwise put a column's formula in place of its name wherever a condition or a later column uses
    it, and compile all of it into one method, which the JVM leaves uncompiled beyond 8,000 bytes.  Neither goes
    through an explode, here of one element; the outer form adds no condition of its own.
    """
    rest = [c for c in df.columns if c not in columns]
    packed = df.select(*rest, F.array(F.struct(*columns)).alias("_settled"))
    each = packed.select(*rest, F.explode_outer("_settled").alias("_row"))
    return each.select(*[F.col(f"_row.{c}").alias(c) if c in columns else c for c in df.columns])


def inline_table(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """A literal table.  Going through Arrow makes it a local relation of known size."""
    records = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)
