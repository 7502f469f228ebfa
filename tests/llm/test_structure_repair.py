"""Conversation repair against an exhaustive search over edits, a chart with all splits, and a plain repair."""

import binascii
import hashlib
import itertools
import random
import re

import pytest

from trialmill.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")


def _audits(token, letter):
    """(cost, edit, initial) of one row, for the exhaustive search."""
    options = [(2, "D", "")]
    if token != "d":
        extra = 5 if token.isupper() else 0
        options += [(extra, "K", letter)] + [(1 + extra, "R", x) for x in "ua"]
    return options


def _search(tokens, most=2):
    """Cheapest (cost, audit) over all edits with up to `most` insertions at each place."""
    inserts = [[(5 * k, "I" * k, "".join(x)) for x in itertools.product("ua", repeat=k)] for k in range(most + 1)]
    inserts = [x for part in inserts for x in part]
    best = None
    places = [inserts]
    for t in tokens:
        places += [_audits(t, t.lower()), inserts]
    for choice in itertools.product(*places):
        cost, audit, out = sum(c[0] for c in choice), "".join(c[1] for c in choice), "".join(c[2] for c in choice)
        if (best is None or (cost, audit) < best) and PATTERN.fullmatch(out):
            best = (cost, audit)
    return best


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_cells_are_the_cheapest_edits(length):
    rng = random.Random(length)
    every = list(itertools.product("dsuaxSUAX", repeat=length))
    for tokens in every if length < 3 else rng.sample(every, 25):
        assert repair.cheapest(repair.parse("".join(tokens))) == _search(tokens, 2 if length < 3 else 1)


def _chart(tokens):
    """CYK with every split of every span."""
    cells = {(i, i + 1): repair.token_cell(t) for i, t in enumerate(tokens)}
    for length in range(2, len(tokens) + 1):
        for i in range(len(tokens) - length + 1):
            found = {}
            for k in range(i + 1, i + length):
                for key, value in repair.combine(cells[i, k], cells[k, i + length]).items():
                    found[key] = min(found.get(key, value), value)
            cells[i, i + length] = found
    return cells[0, len(tokens)]


def test_halves_give_what_all_splits_give():
    rng = random.Random(3)
    for length in (4, 7, 16, 17, 40):
        tokens = "".join(rng.choice("dsuaxSUAXuauaua") for _ in range(length))
        assert repair.parse(tokens) == _chart(tokens)


def _plain(rows):
    """The whole contract for (conv_id, turn, role, text) rows, by conversation, one row after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            role, text = " " if role is None else role, " " if text is None else text
            kind = binascii.crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
        seen, tokens, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in kept:
            plain = text.strip(" \t\n\x0b\f\r")
            fault = "b" if not plain else "d" if (role, text) in seen else "" if plain[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            tokens += "d" if fault in ("b", "d") else letter.upper() if fault else letter
        cost, audit = repair.cheapest(_chart(tokens) if len(tokens) < 30 else repair.parse(tokens)) if tokens else (0, "")
        lines, at, place = [], iter(kept), 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)[1:]
            if edit != "D":
                if edit != "K":
                    role = "assistant" if place == 2 else "user"
                place = {"s": 1, "u": 2, "a": 3}[role[0]]
                lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["b"], counts["d"], counts["t"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _fixture():
    rng = random.Random(11)
    rows = []
    texts = ["Yes.", "No", "", "  \n", "Why?", "Well. ", "a! b", "same", "same.", None, "ü…", "x" * 40 + "1.", "x" * 40 + "2."]
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(0, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows.append((conv, rng.choice([turn, turn, turn, 3, None, turn + 10]), role, rng.choice(texts)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"long talk {t}.") for t in range(700)]
    return rows + rows[:5]


def test_whole_contract(spark, monkeypatch):
    rows = _fixture()
    want = _plain(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, fault int")
    for block in (2048, 3):
        monkeypatch.setattr(repair, "BLOCK", block)  # tasks get the block of the driver with their function
        found = repair.digest(repair.repair(repair.damage(frame.repartition(5)))).collect()
        assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_repaired_rows_read_as_the_pattern(spark):
    frame = spark.createDataFrame(_fixture(), "conv_id long, turn long, role string, text string")
    found = repair.repair(repair.damage(frame)).where("position is not null").collect()
    by_conv = {}
    for r in sorted(found, key=lambda r: r.position):
        by_conv.setdefault(r.conv_id, []).append(r)
    for group in by_conv.values():
        assert PATTERN.fullmatch("".join(r.role[0] for r in group)) and [r.position for r in group] == list(range(len(group)))


def test_empty_table_and_dropped_rows(spark):
    kinds = {binascii.crc32(f"{c}:0".encode()) % 20: c for c in range(500)}
    rows = [(kinds[0], 0, "user", "gone"), (kinds[5], 0, "assistant", "Only.")]
    found = {r.conv_id: r for r in repair.digest(repair.repair(repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert tuple(found[kinds[0]])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[kinds[5]].cost == 2 and found[kinds[5]].audit == "D"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest(repair.repair(repair.damage(empty))).count() == 0
