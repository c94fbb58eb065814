"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from stratamem.llm import turn_repair as T
from stratamem.sources.tables import table

SCHEMA = "conv_id long, turn long, role string, text string, seq long, codes string, range int"
BLANK, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def order(r):
    return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of the damaged rows of one conversation."""
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, _, role, text in rows:
        if not BLANK.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if LAST.search(text)[0] not in ".!?" else "")
        seen.add((role, text))
    # best[state] after all rows: the (cost, audit, output) from there on; inserts are tried twice at most
    ends = {"": (0, "", ()), "s": None, "u": None, "a": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for s, t in NEXT.items():
                if best[t] is not None:
                    found = (best[t][0] + 5, "I" + best[t][1], (f"{NAMES[t]}:", *best[t][2]))
                    if best[s] is None or found[:2] < best[s][:2]:
                        best[s] = found
        return best

    best = inserts(dict(ends))
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        before = {}
        for s in NEXT:
            options = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                initial = role[:1]
                if initial == NEXT[s] or (initial == "s" and s == ""):
                    options.append((best[initial][0] + extra, "K" + best[initial][1], (f"{role}:{text}", *best[initial][2])))
                t = NEXT[s]
                options.append((best[t][0] + extra + 1, "R" + best[t][1], (f"{NAMES[t]}:{text}", *best[t][2])))
            before[s] = min(options, key=lambda x: x[:2])
        best = inserts(before)
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, lines = best[""]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        faults.count("blank"),
        faults.count("duplicate"),
        faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def wanted(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by_conv[r[0]].append(r)
    return {c: plain(x) for c, x in by_conv.items()}


def found(frame):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = T.damaged_digests(frame).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in rows}


def some_rows(seed: int, convs: int, length: int):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "and so", "", " \n\t", "What?", "Go!  ", "é. ", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(length)]), rng.choice(roles), rng.choice(texts) and f"{rng.choice(texts) or ''}{rng.randrange(4)} {rng.choice(texts) or ''}") for _ in range(convs * length)]


@pytest.mark.parametrize("ranges", [16_384, 7])
def test_any_rows(spark, monkeypatch, ranges):
    monkeypatch.setattr(T, "RANGE_ROWS", ranges)  # small ranges: each conversation lies in several
    rows = some_rows(3, 12, 25)
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    assert found(frame) == wanted(rows)


def test_one_conversation_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_ROWS", 100)
    rows = [(7, *r[1:]) for r in some_rows(5, 4, 300)] + [(7, None, "user", "same")] * 500
    assert found(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)) == wanted(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"]: tuple(r[c] for c in columns) for r in entry.queries()["op13_turn_repair"](spark, d).collect()}
    assert got == wanted(rows)


def test_empty_and_dropped(spark):
    assert T.damaged_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Yes.")]
    assert found(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_real_outputs(spark):
    turns = spark.createDataFrame([(1, 0, "tool", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 3, "user", "So?")], "conv_id long, turn long, role string, text string")
    got = T.repair(turns)
    assert [r["audit"] for r in got.summary.collect()] == ["RKDD"]
    assert [(r["role"], r["text"], r["edit"]) for r in got.repaired().orderBy("seq", "place").collect()] == [("user", "Hi.", "R"), ("assistant", "Yes.", "K")]
