"""Snapshots: their size as JSON, the cap on it, and the texts made of them.

A snapshot is the columns task, status (strings), completed, in_progress, next_steps,
key_decisions, blockers, files_modified (arrays of strings), in this order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions import fixed as V

TEXTS = ("task", "status")
LISTS = ("completed", "in_progress", "next_steps", "key_decisions", "blockers", "files_modified")
HEADINGS = {"completed": "Completed", "in_progress": "In Progress", "next_steps": "Next Steps", "key_decisions": "Key Decisions", "blockers": "Blockers"}


def json_length(text: Column) -> Column:
    """Characters of a text as a JSON string of ASCII characters; null is ``null``."""
    short = F.regexp_count(text, F.lit(r'["\\\n\r\t\x08\f]'))
    control = F.regexp_count(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    wide, pairs = F.regexp_count(text, F.lit(r"[^\x00-\x7F]")), F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.coalesce(F.length(text) + 2 + short + 5 * control + 5 * wide + 6 * pairs, F.lit(4))


def _list_length(items: Column) -> Column:
    return F.aggregate(items, F.lit(2), lambda n, x: n + json_length(x)) + 2 * F.greatest(F.size(items) - 1, F.lit(0))


def snapshot_length() -> Column:
    """Characters of a snapshot as a JSON object."""
    names = sum(len(name) + 4 for name in (*TEXTS, *LISTS)) + 2 * (len(TEXTS) + len(LISTS) - 1) + 2
    total = F.lit(names)
    for name in TEXTS:
        total = total + json_length(F.col(name))
    for name in LISTS:
        total = total + _list_length(F.coalesce(name, F.array().cast("array<string>")))
    return total


def capped(snapshots: DataFrame, most: int = V.SNAPSHOT_CHARS) -> DataFrame:
    """``snapshots`` whose lists lose their last items, list after list, until the JSON has ``most`` characters or one item is left of each.

    Null lists count as empty ones; other columns stay.
    """
    out = snapshots.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in LISTS})
    out = out.withColumn("_over", snapshot_length() - most)
    for name in V.SNAPSHOT_LISTS:
        start = F.struct(F.col("_over").alias("over"), F.size(name).alias("keep"))

        def pop(state: Column, item: Column) -> Column:
            go = (state["over"] > 0) & (state["keep"] > 1)
            return F.struct(F.when(go, state["over"] - json_length(item) - 2).otherwise(state["over"]).alias("over"), F.when(go, state["keep"] - 1).otherwise(state["keep"]).alias("keep"))

        out = out.withColumn("_state", F.aggregate(F.reverse(name), start, pop))
        out = out.withColumns({name: F.slice(name, F.lit(1), F.col("_state.keep")), "_over": F.col("_state.over")}).drop("_state")
    return out.drop("_over")


def _section(name: str, heading: str) -> Column:
    lines = F.transform(name, lambda x: F.concat(F.lit("  - "), x))
    return F.when(F.size(name) > 0, F.concat(F.lit(f"**{heading}:**\n"), F.array_join(lines, "\n")))


def context_block(device: Column) -> Column:
    """A snapshot as the block that opens a new session."""
    head = [F.concat(F.lit(f"**{label}:** "), F.coalesce(value, F.lit("unknown"))) for label, value in (("Device", device), ("Task", F.col("task")), ("Status", F.col("status")))]
    files = F.when(F.size("files_modified") > 0, F.concat(F.lit("**Files Modified:** "), F.array_join("files_modified", ", ")))
    return F.concat_ws("\n", F.lit("## Session State (from previous session)"), *head, *(_section(n, h) for n, h in HEADINGS.items()), files, F.lit(""))


def rerank_text(*fields: Column | str, longest: int = 1500) -> Column:
    """The first of the fields that isn't blank, cut; empty if all are."""
    fields = [F.col(f) if isinstance(f, str) else f for f in fields]
    return F.left(F.coalesce(*(F.when(~F.regexp_like(f, F.lit(r"^[\s\p{Z}]*$")), f) for f in fields), F.lit("")), F.lit(longest))


def from_summary(summary: Column) -> dict[str, Column]:
    """The columns of the snapshot that a summary's lines make: each line in the list of its first keyword."""
    from stratamem.functions.guard import summary_kind, summary_task
    from stratamem.functions.text import strip

    lines = F.split(summary, "\n", -1)

    def of_kind(name: str) -> Column:
        return F.transform(F.filter(lines, lambda x: summary_kind(x) == name), strip)

    lists = {name: of_kind(name) for name in V.SUMMARY_KEYWORDS}
    return {"task": summary_task(lines), "status": F.lit("completed"), **lists, "files_modified": F.array().cast("array<string>"), "raw_summary": F.left(summary, F.lit(2000))}
