"""Sharding by a permutation-filled lookup table.

Every shard walks a prime-sized table in an order of its own (an offset and a skip from its name's
hash); the shards take turns and each claims its next free slot.  A document's hash picks a slot,
the slot names the shard.  Shares differ by one slot at most, and a shard that joins or leaves moves
few slots that it does not own.  The table has `slots` rows whatever the input, so its broadcast is
bounded, and placing a document needs no shuffle.

Defined cases: rows without doc_id are placed by their text (null as empty); repeated rows share a
shard; an empty table stays empty; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trialmill.llm.common import id_hash
from trialmill.session import inline_table

SLOTS = 16381


def preferences(name: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order; with a prime table every skip visits all slots."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill_table(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Owner (position in `names`) of every slot."""
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("names must be distinct, and from one to as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    owner = [-1] * slots
    at, skip = map(list, zip(*(preferences(n, slots) for n in names)))
    filled = 0
    while True:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            filled += 1
            if filled == slots:
                return owner


def lookup_table(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    schema = T.StructType([T.StructField("_slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)])
    return inline_table(spark, schema, [(slot, names[i]) for slot, i in enumerate(fill_table(names, slots))])


def place(docs: DataFrame, names: Sequence[str], slots: int = SLOTS, seed: str = "shard") -> DataFrame:
    """`docs` with `slot` and `shard`."""
    docs = docs.drop("slot", "shard", "_slot")
    text = F.col("text") if "text" in docs.columns else F.lit("")
    slotted = docs.withColumn("slot", id_hash(F.col("doc_id"), text, seed) % slots)
    table = F.broadcast(lookup_table(docs.sparkSession, names, slots))  # `slots` rows at any input size
    return slotted.join(table, F.col("slot") == F.col("_slot")).select(*docs.columns, "slot", "shard")


def shard_names(count: int) -> list[str]:
    width = len(str(count - 1))
    return [f"shard-{i:0{width}d}" for i in range(count)]
