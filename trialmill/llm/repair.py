"""Conversation structure repair by weighted CYK parsing of intervals.

Rows of a conversation are tokens; a repaired conversation must read `(s?(ua)+)?` in role initials.  The grammar in
Chomsky normal form has a nonterminal for each pair of places in that pattern, `p>q` (what lies between was
read from p to q), with the rules `p>q -> p>r r>q`, and lexical rules for one row: Keep 0, Rerole 1, Delete 2, and 5
more for a truncated row that stays.  Insertions (5 each) are the closure: every cell may begin and end with inserted
turns.  The cell of a span holds the cheapest (cost, audit) of each nonterminal, ties to the ASCII-least audit.

Two facts make the work small.  Every way to split a span gives the same cell, since the places are read from
left to right, so a span of length 2k comes from two of length k, bottom-up, instead of all its splits.  And
the least audit of a whole is made of least audits of its parts: of two audits of one cost neither begins with
the other (what is left over would be insertions alone, which cost), so what follows never turns their order.

In Spark, slim rows (no texts) are sorted by range, so that a conversation of any length spreads over tasks;
blocks of `BLOCK` rows are parsed where they lie and their cells are combined per conversation.  Then texts
stream past in order, once, and the audit is applied to them.

Rows of one turn stand by role, then by text (first 32 characters, then md5).

Defined cases: null conv_id, turn, role and text count as one space where text is made of them, a null turn sorts
first and has no part in the gaps, rows with a null conv_id are one conversation; a role's initial is its first
character (an empty role has none); a conversation whose rows were all dropped has zeros, an empty audit and no
repaired rows; an empty table stays empty; columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialmill.llm.common import cut_lineage
from trialmill.session import forget

#: Places of the pattern: before anything, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PLACES = 4
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 2048

#: A cell: for each nonterminal (p, q) the least (cost, audit).
Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans: all rules p>q -> p>r r>q."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r2 == r:
                best = out.get((p, q))
                if best is None or cost + more < best[0] or (cost + more == best[0] and audit + rest < best[1]):
                    out[p, q] = (cost + more, audit + rest)
    return out


def _insertions() -> Cell:
    """The cell of the empty span: shortest insertions of user and assistant turns."""
    one = {(p, p): (0, "") for p in range(PLACES)} | {(p, q): (INSERT, "I") for (p, letter), q in STEPS.items() if letter != "s"}
    out = one
    for _ in range(PLACES):
        out = combine(out, one)
    return out


EMPTY = _insertions()


@lru_cache(maxsize=64)
def token_cell(token: str) -> Cell:
    """The cell of one row, closed under insertions.

    Tokens: `d` must go; s, u, a and `x` (another initial) may stay; S, U, A and X are truncated.
    """
    cell: Cell = {(p, p): (DELETE, "D") for p in range(PLACES)}
    if token != "d":
        extra = TRUNCATED if token.isupper() else 0
        for (p, letter), q in STEPS.items():
            options = [(KEEP + extra, "K")] if token.lower() == letter else []
            if letter != "s":
                options.append((REROLE + extra, "R"))
            for option in options:
                cell[p, q] = min(cell.get((p, q), option), option)
    return combine(combine(EMPTY, cell), EMPTY)


def joined(cells: list[Cell]) -> Cell:
    """The cell of a row of spans, by doubling span lengths."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


@lru_cache(maxsize=20_000)
def _short(tokens: str) -> Cell:
    return joined([token_cell(t) for t in tokens])


def parse(tokens: str) -> Cell:
    """The cell of a string of tokens."""
    return _short(tokens) if len(tokens) <= 16 else joined([_short(tokens[i : i + 8]) for i in range(0, len(tokens), 8)])


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after planned damage, with a flag for those dropped: (conv_id, turn, role, text, dropped).

    crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it,
    4 makes it a user's.
    """
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _order(text: Column) -> list[Column]:
    """What rows of one turn stand by after their role."""
    return [F.substring(text, 1, 32).alias("head"), F.md5(text.cast("binary")).alias("digest")]


def _slim(rows: DataFrame) -> DataFrame:
    """Rows without their texts: order, initial and what can be told from one row alone."""
    filled = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(filled == "", "b").when(F.substring(filled, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    return rows.select(
        "conv_id", "turn", "role", *_order(F.col("text")), F.when(~F.col("dropped"), fault).alias("fault"), "dropped",
        F.monotonically_increasing_id().alias("id"),
    )


def _repeated(slim: DataFrame) -> DataFrame:
    """(conversation, role, text) that stand in several rows, and the row that is first."""
    first = F.min(F.struct("turn", "id")).alias("first")
    found = slim.where("not dropped").groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    return found.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("first.id").alias("_first"))


#: Order of a block (that of its first row), its figures, and its cell as three arrays.
BLOCK_TYPE = (
    "turn bigint, role string, head string, digest string, id bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, turns bigint, least bigint, most bigint, first_initial string, last_initial string, last_turn bigint, "
    "pq array<int>, cost array<bigint>, audit array<string>"
)


class _Block:
    """What one task knows of a run of a conversation's rows."""

    def __init__(self, key: tuple) -> None:
        self.key, self.tokens, self.cells = key, [], []
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.n = self.illegal = self.turns = 0
        self.least = self.most = self.first = self.last = None

    def add(self, turn, initial, fault, dropped) -> None:
        if dropped:
            return
        if self.n and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if not self.n:
            self.first = initial
        self.n, self.last = self.n + 1, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if fault:
            self.counts[fault] += 1
        if fault in ("b", "d"):
            token = "d"
        else:
            token = initial if initial in ("s", "u", "a") else "x"
            token = token.upper() if fault else token
        self.tokens.append(token)

    def row(self) -> tuple:
        cell = parse("".join(self.tokens))
        keys = sorted(cell)
        return (
            *self.key, self.n, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.turns, self.least, self.most,
            self.first, self.last, self.most, [p * PLACES + q for p, q in keys], [cell[k][0] for k in keys], [cell[k][1] for k in keys],
        )


def _blocks(schema: pa.Schema):
    """Sorted slim rows -> a row for each run of up to BLOCK rows of a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "head", "digest", "id", "fault", "dropped")]
            for conv, turn, role, head, digest, row_id, fault, dropped in zip(*columns):
                if block is None or conv != at or block.n >= BLOCK:
                    if block is not None:
                        done.append((at, *block.row()))
                    at, block = conv, _Block((turn, role, head, digest, row_id))
                block.add(turn, role[:1], fault, dropped)
            if done:
                yield _batch(done, schema)
        if block is not None:
            yield _batch([(at, *block.row())], schema)

    return run


HEAD_TYPE = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _heads(schema: pa.Schema):
    """Sorted blocks -> a row for each conversation."""
    names = ["conv_id", "n", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "first_initial", "last_initial", "pq", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def head(rows):
            # counts of blank, duplicate, truncated, illegal, turns; blocks without rows keep nothing
            total = [sum(r[i] for r in rows) for i in range(2, 7)]
            rows = [r for r in rows if r[1]]
            for one, two in zip(rows, rows[1:]):
                total[3] += one[10] + two[9] not in ("su", "ua", "au")
                total[4] -= two[7] is not None and one[8] == two[7]
            dated = [r for r in rows if r[7] is not None]
            gaps = dated[-1][8] - dated[0][7] + 1 - total[4] if dated else 0
            cell = joined([{divmod(k, PLACES): (c, a) for k, c, a in zip(r[11], r[12], r[13])} for r in rows])
            return (at, gaps, *total[:4], *cheapest(cell))

        for batch in batches:
            done = []
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                if held and row[0] != at:
                    done.append(head(held))
                    held = []
                at = row[0]
                held.append(row)
            if done:
                yield _batch(done, schema)
        if held:
            yield _batch([head(held)], schema)

    return run


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of damaged rows, one row a conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    slim = cut_lineage(_slim(rows))
    again = cut_lineage(_repeated(slim))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    later = (F.col("_first") != F.col("id")) & (F.col("fault") != "b") & ~F.col("dropped")
    marked = slim.join(again, same, "left").withColumn("fault", F.when(later, "d").otherwise(F.col("fault")))
    order = ["conv_id", "turn", "role", "head", "digest", "id"]
    marked = marked.select(*order, "fault", "dropped")
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    block_type = f"conv_id {kind}, {BLOCK_TYPE}"
    blocks = cut_lineage(ranged.mapInArrow(_blocks(_arrow(block_type)), block_type))
    forget(slim, again)
    whole = blocks.repartition("conv_id").sortWithinPartitions(*order)
    head_type = f"conv_id {kind}, {HEAD_TYPE}"
    heads = cut_lineage(whole.mapInArrow(_heads(_arrow(head_type)), head_type))
    forget(blocks)
    return heads


REPAIRED_TYPE = f"{HEAD_TYPE}, position bigint, edit string, role string, text string"


def _repaired(schema: pa.Schema):
    """A conversation's head, then its rows in order -> the head (position null), then its repaired rows."""
    heads = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"place": 0, "at": 0, "audit": "", "position": 0}

        def edits(conv, out, row=None):
            """Apply letters up to and with the one that takes `row`; all that is left without a row."""
            while state["at"] < len(state["audit"]):
                edit = state["audit"][state["at"]]
                if edit != "I" and row is None:
                    break
                state["at"] += 1
                role, text = ("", "") if edit == "I" else row
                if edit == "K":
                    state["place"] = STEPS[state["place"], role[:1]]
                elif edit != "D":
                    role = "assistant" if state["place"] == 2 else "user"
                    state["place"] = STEPS[state["place"], role[0]]
                if edit != "D":
                    out.append((conv, *[None] * len(heads), state["position"], edit, role, text))
                    state["position"] += 1
                if edit != "I":
                    break

        for batch in batches:
            out, held = [], 0
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", *heads)]
            for conv, part, role, text, *head in zip(*columns):
                if part == 0:
                    state.update(place=0, at=0, audit=head[-1], position=0)
                    out.append((conv, *head, None, None, None, None))
                else:
                    edits(conv, out, (role, text))
                    held += len(text)
                # insertions that follow this row, or stand before the first
                edits(conv, out)
                if held > 8_000_000:
                    yield _batch(out, schema)
                    out, held = [], 0
            if out:
                yield _batch(out, schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of damaged rows (conv_id, turn, role, text, dropped).

    For each conversation one row with position null (its counts, cost and audit), then its repaired rows with
    position, edit, role and text.  A conversation's rows follow each other in one partition, in order.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = audits(rows)
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    first = heads.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit("").alias("head"), F.lit("").alias("digest"), *figures,
    )
    types = dict(f.strip().split(" ") for f in HEAD_TYPE.split(","))
    texts = rows.where("not dropped").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "text", *_order(F.col("text")), *[F.lit(None).cast(types[c]).alias(c) for c in figures],
    )
    stream = first.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "head", "digest")
    ddl = f"conv_id {kind}, {REPAIRED_TYPE}"
    return stream.select("conv_id", "part", "role", "text", *figures).mapInArrow(_repaired(_arrow(ddl)), ddl)


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its figures and the SHA-256 of its repaired `role:text` lines, which stream past in order."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    ddl = f"conv_id {kind}, {HEAD_TYPE}, repaired_sha256 string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha = None, None

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", *names, "position", "role", "text")]
            for *figures, position, role, text in zip(*columns):
                if position is None:
                    if head is not None:
                        done.append((*head, sha.hexdigest()))
                    head, sha = figures, hashlib.sha256()
                else:
                    sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if done:
                yield _batch(done, schema)
        if head is not None:
            yield _batch([(*head, sha.hexdigest())], schema)

    return repaired.mapInArrow(run, ddl)
