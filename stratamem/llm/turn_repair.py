"""Repair of conversation structure by cheapest edits.

The rows of a conversation and how far its role pattern has come span a graph whose arcs are
edits with small integer costs: Keep, Rerole, Delete and Insert. Dial's bucket queue records
what each node still costs to the end; the edits are read off by walking, at each node, the
least letter among the arcs that lose nothing.

A conversation may hold any share of all rows, so rows are dealt in ranges. A range solves
its part of a conversation; parts of one conversation meet by what each costs between any
two states (16 numbers for each range), from its end, and by the state each is entered in,
from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.shared import lean, materialise, small_batches

#: Rows of a range, about; what a task solves at once.
RANGE_ROWS = 16_384

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing yet, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What the end still costs from each state: insertions up to an assistant's row.
AT_END = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 30

#: A row as a number: its role's initial (0 other, 1 s, 2 u, 3 a), plus 4 if its text is cut short, plus 8 if it has to go.
INITIALS, TRUNCATED, GONE = " sua", 4, 8
_BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: More than what any two labels in the queue are apart.
RING = 64


def _arcs() -> tuple[list, list]:
    """For each kind of row: by state before, the (letter and role, state after, cost), least letter first; and by state after, the (state before, cost)."""
    ahead, back = [], []
    for code in range(16):
        initial, extra = code & 3, CUT if code & TRUNCATED else 0
        arcs = [[("D-", s, DELETE)] for s in range(STATES)]
        if not code & GONE:
            for after, befores in _BEFORE.items():
                for s in befores:
                    if initial == after:
                        arcs[s].append((f"K{INITIALS[after]}", after, extra))
                    elif after != SYSTEM:
                        arcs[s].append((f"R{INITIALS[after]}", after, REROLE + extra))
        ahead.append([sorted(x) for x in arcs])
        back.append([[(s, cost) for s in range(STATES) for _, after, cost in arcs[s] if after == t] for t in range(STATES)])
    return ahead, back


_AHEAD, _BACK = _arcs()
_INSERTED = [[(s, INSERT) for s in _AFTER if _AFTER[s] == t] for t in range(STATES)]


def costs_to_go(codes: list[int], exits: list[int]) -> list[int]:
    """What node (i, s), at place ``STATES * i + s``, costs to the end, given what each state costs after the last row.

    Dial's algorithm backwards: labels wait in a ring of buckets, as arcs cost little and
    exits are either near each other or ``FAR``.
    """
    last = STATES * len(codes)
    found = [FAR] * (last + STATES)
    buckets: list[list[int]] = [[] for _ in range(RING)]
    waiting, at = 0, min(exits)
    for s, cost in enumerate(exits):
        if cost < FAR:
            found[last + s] = cost
            buckets[cost % RING].append(last + s)
            waiting += 1
    while waiting:
        bucket = buckets[at % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if found[node] != at:
                continue
            state = node % STATES
            here = node - state
            for s, cost in _INSERTED[state]:
                if at + cost < found[here + s]:
                    found[here + s] = at + cost
                    buckets[(at + cost) % RING].append(here + s)
                    waiting += 1
            if here:
                here -= STATES
                for s, cost in _BACK[codes[here // STATES]][state]:
                    if at + cost < found[here + s]:
                        found[here + s] = at + cost
                        buckets[(at + cost) % RING].append(here + s)
                        waiting += 1
        at += 1
    return found


def walk(codes: list[int], left: list[int], state: int, ends: bool) -> tuple[str, int, int]:
    """The least letters of a cheapest way from ``state``, each with the role's initial it makes (``-``: none), its cost, and the state after it.

    Insertions after the last row belong to what follows, or to this part if it ``ends``.
    """
    steps, i, n, start = [], 0, len(codes), left[state]
    while i < n or (ends and left[STATES * n + state]):
        here = left[STATES * i + state]
        arcs = _AHEAD[codes[i]][state] if i < n else []
        inserted = _AFTER[state]
        for letter, after, cost in sorted([*arcs, (f"I{INITIALS[inserted]}", inserted, INSERT)]):
            row = letter[0] != "I"
            if here == cost + left[STATES * (i + row) + after]:
                steps.append(letter)
                state, i = after, i + row
                break
    return "".join(steps), start - left[STATES * n + state], state


@dataclass(frozen=True)
class Repair:
    """``rows`` (seq, conv, conv_id, turn, role, text, blank, duplicate, truncated) in order of ``seq``,
    ``steps`` (conv, first_seq, steps, cost) of each part of a conversation, and ``summary`` of each conversation:
    conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    rows: DataFrame
    steps: DataFrame
    summary: DataFrame

    def repaired(self) -> DataFrame:
        """(conv, conv_id, seq, place, role, text, edit) of the rows after the edits, in the order of (``conv``, ``seq``, ``place``)."""
        pieces = self.steps.select("first_seq", F.posexplode(F.regexp_extract_all("steps", F.lit("(?:I.)*[DKR].(?:(?:I.)+$)?"), F.lit(0))).alias("pos", "piece"))
        edits = pieces.select((F.col("first_seq") + F.col("pos")).alias("_seq"), F.regexp_extract_all("piece", F.lit(".."), F.lit(0)).alias("edits"))
        met = self.rows.join(edits, F.col("seq") == F.col("_seq"))
        each = met.select("conv", "conv_id", "seq", F.posexplode("edits").alias("place", "step"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        edit, to = F.left("step", F.lit(1)), F.when(F.right("step", F.lit(1)) == "u", "user").otherwise("assistant")
        return each.where(edit != "D").select(
            "conv",
            "conv_id",
            "seq",
            "place",
            F.when(edit == "K", F.col("_role")).otherwise(to).alias("role"),
            F.when(edit == "I", "").otherwise(F.col("_text")).alias("text"),
            edit.alias("edit"),
        )


def key_of(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``conversations``, damaged by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the row, 4 makes
    its role user. A null id or turn counts as one space there; a null role or text is one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` in order, numbered by ``seq`` and written, with the fault of each."""
    n = rows.count()
    keyed = rows.withColumns({"conv": key_of(F.col("conv_id")), "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    keyed = keyed.withColumns({"_digest": F.sha2("text", 256), "_salt": F.xxhash64(F.monotonically_increasing_id())})
    order = ["conv", F.asc_nulls_first("turn"), "role", "_digest", "_salt"]
    dealt = keyed.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    last = F.regexp_extract("text", "([^ \\x09-\\x0D])[ \\x09-\\x0D]*\\z", 1)
    numbered = dealt.select(
        F.monotonically_increasing_id().alias("seq"),  # grows along the ranges and inside them
        F.spark_partition_id().alias("range"),
        "conv",
        "conv_id",
        "turn",
        "role",
        "text",
        "_digest",
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("_cut"),
    )
    numbered = materialise(numbered, "turns")
    firsts = numbered.groupBy("conv", "role", "_digest").agg(F.min("seq").alias("_first")).select("_first")
    met = numbered.join(firsts, F.col("seq") == F.col("_first"), "left")
    seen = ~F.col("blank") & F.col("_first").isNull()
    return met.withColumns({"duplicate": seen, "truncated": ~F.col("blank") & ~seen & F.col("_cut")}).drop("_digest", "_cut", "_first")


SOLVED = "conv string, first_seq long, steps string, cost long"


def _with(batch: pd.DataFrame, found: list[tuple[str, int]]) -> pd.DataFrame:
    return batch[["conv", "first_seq"]].assign(steps=[x[0] for x in found], cost=pd.Series([x[1] for x in found], dtype="int64", index=batch.index))


def _solve(parts: DataFrame) -> DataFrame:
    """(conv, first_seq, steps, cost) of conversations that lie in one range each: (conv, first_seq, codes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for codes in batch["codes"]:
                codes = codes.tolist()
                found.append(walk(codes, costs_to_go(codes, AT_END), START, ends=True)[:2])
            yield _with(batch, found)

    return parts.select("conv", "first_seq", "codes").mapInPandas(lean(run), SOLVED)


def _solve_across(parts: DataFrame) -> DataFrame:
    """As ``_solve``, of conversations that lie in several ranges: (conv, first_seq, last_range, codes)."""

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            costs = []
            for codes in batch["codes"]:
                ways = [costs_to_go(codes.tolist(), [0 if s == t else FAR for s in range(STATES)])[:STATES] for t in range(STATES)]
                costs.append([ways[t][s] for s in range(STATES) for t in range(STATES)])
            yield batch[["conv", "first_seq"]].assign(costs=costs)

    def backwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, exits, found = pdf.sort_values("first_seq", ascending=False), AT_END, []
        for costs in pdf["costs"]:
            found.append(exits)
            exits = [min(FAR, *(costs[STATES * s + t] + exits[t] for t in range(STATES))) for s in range(STATES)]
        least = [min(x) for x in found]  # only differences matter, and large numbers would not fit the ring
        return pdf[["conv", "first_seq"]].assign(exits=[[x - n for x in e] for e, n in zip(found, least, strict=True)])

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ways = []
            for codes, exits, ends in zip(batch["codes"], batch["exits"], batch["ends"], strict=True):
                codes = codes.tolist()
                left = costs_to_go(codes, exits.tolist())
                ways.append([walk(codes, left, s, ends)[2] for s in range(STATES)])
            yield batch[["conv", "first_seq"]].assign(ways=ways)

    def forwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, found = pdf.sort_values("first_seq"), START, []
        for ways in pdf["ways"]:
            found.append(state)
            state = ways[state]
        return pdf[["conv", "first_seq"]].assign(entry=found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for codes, exits, ends, entry in zip(batch["codes"], batch["exits"], batch["ends"], batch["entry"], strict=True):
                codes = codes.tolist()
                found.append(walk(codes, costs_to_go(codes, exits.tolist()), entry, ends)[:2])
            yield _with(batch, found)

    costs = parts.select("conv", "first_seq", "codes").mapInPandas(lean(between), "conv string, first_seq long, costs array<int>")
    exits = costs.groupBy("conv").applyInPandas(backwards, "conv string, first_seq long, exits array<int>").select(F.col("first_seq").alias("_s"), "exits")
    known = materialise(parts.join(exits, F.col("first_seq") == F.col("_s")).select("conv", "first_seq", "codes", "exits", (F.col("range") == F.col("last_range")).alias("ends")), "turn-exits")
    ways = known.mapInPandas(lean(through), "conv string, first_seq long, ways array<int>")
    entries = ways.groupBy("conv").applyInPandas(forwards, "conv string, first_seq long, entry int").select(F.col("first_seq").alias("_s"), "entry")
    return known.join(entries, F.col("first_seq") == F.col("_s")).mapInPandas(lean(run), SOLVED)


def _illegal(before: Column, after: Column) -> Column:
    """Whether two initials may not follow each other."""
    return ~(((before == 1) & (after == 2)) | ((before == 2) & (after == 3)) | ((before == 3) & (after == 2)))


def repair(turns: DataFrame) -> Repair:
    """Cheapest edits that give each conversation of ``turns`` (conv_id, turn, role, text) the roles ``(system? (user assistant)+)?``.

    Rows are taken by turn, nulls first, and equal turns by role and text. A row's first fault
    counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen before in the
    conversation), ``truncated`` (its last character other than white space is none of ``.!?``).
    Keep costs 0, Rerole to user or assistant 1, Delete 2, and is the only edit of a blank row or
    a duplicate, Insert of an empty row 5; a truncated row that stays costs 5 more. Of equally
    cheap edits those whose initials are least in ASCII are made: ``audit`` has one letter for each.

    Edge cases: a null role or text is one space; rows with a null id are one conversation;
    repeated rows are duplicates; long conversations and texts are taken whole; an empty
    table gives empty results; other columns are ignored.
    """
    small_batches(turns.sparkSession)
    rows = materialise(_judged(turns.select("conv_id", "turn", "role", "text")), "turns-judged")
    initial = F.lit(0)
    for n, letter in enumerate(INITIALS):
        if n:
            initial = F.when(F.left("role", F.lit(1)) == letter, n).otherwise(initial)
    code = initial + F.when(F.col("truncated"), TRUNCATED).otherwise(0) + F.when(F.col("blank") | F.col("duplicate"), GONE).otherwise(0)
    listed = F.sort_array(F.collect_list(F.struct("seq", code.cast("byte").alias("code"))))
    counted = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    parts = rows.groupBy("conv", "range").agg(F.first("conv_id").alias("conv_id"), F.min("seq").alias("first_seq"), listed.alias("_l"), *counted)
    parts = materialise(parts.withColumn("codes", F.transform("_l", lambda x: x["code"])).drop("_l"), "turn-parts")  # a row for each conversation and range

    initials = F.transform("codes", lambda x: x.cast("int").bitwiseAND(3))
    inside = F.size(F.filter(F.zip_with(F.slice("_i", 1, F.size("_i") - 1), F.slice("_i", 2, F.size("_i")), _illegal), lambda x: x)).cast("long")
    whole, along = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("range")
    brief = parts.withColumn("_i", initials).select("conv", "range", "conv_id", "first_seq", "blank", "duplicate", "truncated", inside.alias("_inside"), F.col("_i")[0].alias("_left"), F.element_at("_i", -1).alias("_right"))
    brief = brief.withColumns({"first_range": F.min("range").over(whole), "last_range": F.max("range").over(whole), "_before": F.lag("_right").over(along)})
    across = F.when(F.col("_before").isNotNull() & _illegal(F.col("_before"), F.col("_left")), 1).otherwise(0)
    counts = brief.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("_inside") + across).alias("illegal"))

    bounds = brief.select(F.col("first_seq").alias("_s"), "first_range", "last_range")
    bounded = parts.select("conv", "range", "first_seq", "codes").join(bounds, F.col("first_seq") == F.col("_s")).drop("_s")
    steps = materialise(_solve(bounded.where("first_range = last_range")).unionByName(_solve_across(bounded.where("first_range < last_range"))), "turn-steps")
    letters = F.regexp_replace("steps", "(.).", "$1")
    audits = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("first_seq", letters.alias("letters")))).alias("_l"), F.sum("cost").alias("cost"))
    audits = audits.select(F.col("conv").alias("_c"), F.array_join(F.transform("_l", lambda x: x["letters"]), "").alias("audit"), "cost")
    spread = rows.where("turn is not null").select("conv", "turn").distinct().groupBy(F.col("conv").alias("_t")).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    met = counts.join(audits, F.col("conv") == F.col("_c")).join(spread, F.col("conv") == F.col("_t"), "left")
    summary = met.select(
        "conv",
        "conv_id",
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        "audit",
    )
    return Repair(rows, steps, summary)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of each conversation that has rows left: of ``role:text``, joined by newlines.

    Rows stream past in order, so a task holds one Arrow batch however long a conversation is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for conv, line in zip(batch["conv"], batch["line"], strict=True):
                if conv != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    lines = repaired.select("conv", "seq", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "seq", "place").select("conv", "line").mapInPandas(lean(run), "conv string, repaired_sha256 string")


def damaged_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations``, damaged and repaired: its faults, the cost and audit of the repair, and a digest of what it gives."""
    found = repair(damage(conversations))
    sums = digests(found.repaired()).select(F.col("conv").alias("_d"), "repaired_sha256")
    facts = found.summary.drop("conv_id")
    ids = conversations.select(key_of(F.col("conv_id")).alias("_c"), "conv_id").distinct()
    met = ids.join(facts, F.col("_c") == F.col("conv"), "left").join(sums, F.col("_c") == F.col("_d"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
