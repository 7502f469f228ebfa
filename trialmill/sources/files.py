"""Reading and writing the experiment's files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def normal_names(names: list[str]) -> list[str]:
    return [n.strip().lower() for n in names]


def keep_first_columns(names: list[str]) -> list[int]:
    """Positions to keep: the first of each name, and none with a `.1`-style copy suffix."""
    seen, kept = set(), []
    for i, name in enumerate(names):
        if name not in seen and not re.search(r"\.\d+$", name):
            seen.add(name)
            kept.append(i)
    return kept


def read_corpus(spark: SparkSession, path: str, types: dict[str, str] | None = None,
                multi_line: bool = False) -> DataFrame:
    """A headered CSV with trimmed lower-case names and repeated columns dropped.

    Only the header line is read ahead; columns are text unless `types` says otherwise.
    An empty field, quoted or not, is NULL.  `multi_line` allows line breaks inside quotes, at the price that files are not split.
    """
    header = spark.read.csv(path, header=False).first()
    names = normal_names([v or "" for v in header])
    slots = [f"_{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(s, T.StringType()) for s in slots])
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=multi_line, escape='"')
    types = types or {}
    return raw.select([
        (F.col(slots[i]).try_cast(types[names[i]]) if names[i] in types else F.col(slots[i])).alias(names[i])
        for i in keep_first_columns(names)])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON arrays of records, one array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """A result table as CSV, floating columns rounded."""
    rounded = [F.round(f"`{f.name}`", places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
               else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(rounded).write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A JSON array of records per part file; records stream through, no partition is held whole."""
    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": [mark + batch["record"].iloc[0], *("," + batch["record"].iloc[1:])]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    records.mapInPandas(bracketed, "value string").write.mode("overwrite").text(path)
