"""Bounded samples of labelled documents for fitting, and the split that stays out of it.

A sample holds at most `per_class` rows of either label and `max_bytes` of text, chosen by the md5 of
the id; a text that does not fit any more is passed over.  These bounds are the only ones: scoring covers every row.  Rows without doc_id have no label
and count as held out.  Where labels repeat for an id, one 1 makes it 1;
of documents that repeat an id the smallest text counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


class Row(NamedTuple):
    text: bytes
    label: int
    lang: str


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[Row], float]:
    """The sample in md5 order, and the share of label 1 among all rows that may be learnt from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rate = usable.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = [
        usable.where((F.col("y") > 0) == bool(y)).withColumn("_order", order).orderBy("_order", "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).join(ids, "doc_id")
    # one row an id, that with the smallest text
    one = F.min(F.struct("text", "lang")).alias("_one")
    texts = texts.where("text is not null").groupBy("doc_id", "y", "_order").agg(one).select("doc_id", "y", "_order", "_one.text", "_one.lang")
    sizes = sorted(texts.select("_order", "doc_id", F.octet_length("text").alias("size")).collect())
    taken, total = [], 0
    for row in sizes:
        if total + row.size > max_bytes:  # a shorter one may still fit
            continue
        total += row.size
        taken.append(row.doc_id)
    if not taken:
        return [], float(rate or 0.0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in taken], f"doc_id {kind}"))
    rows = texts.join(counted, "doc_id", "left_semi").collect()
    rows.sort(key=lambda r: (r._order, r.text))
    return [Row(r.text.encode(), int(r.y > 0), r.lang or "") for r in rows], float(rate or 0.0)
