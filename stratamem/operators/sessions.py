"""Sessions, their episodes, and the context a new session wakes up with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions.text import strip


def numbered(episodes: DataFrame, session: str, *order: Column) -> DataFrame:
    """Episodes with ``session_order`` from 0."""
    return episodes.withColumn("session_order", F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_n(rows: DataFrame, keys: list[str], n: int, order: str) -> DataFrame:
    """The last ``n`` rows of each group, as ``position`` from 1 in their order."""
    back = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n)
    return back.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).drop("_n")


#: The first line of what a session wakes up with.
HEADING = "## Key Context (last 30 days)"


def wake_up(items: DataFrame, budget: int = 500, most: int = 15) -> DataFrame:
    """The items (group_id, room, id, score, text, and type if there is one) that fit the budget, with the tokens spent so far, and their ``line``.

    A group's ``most`` best items that have a text are taken. Rooms come by their best item,
    items by score. Tokens are a quarter of the characters of what is printed: the heading,
    ``**room:**`` after an empty line, and ``[type] text`` with the text cut at 120
    characters. Nothing comes after the first that does not fit.
    """
    kind = F.col("type") if "type" in items.columns else F.lit("fact")
    short = F.concat(strip(F.left("text", F.lit(120))), F.when(F.length("text") > 120, "...").otherwise(""))
    told = items.where(F.coalesce("text", F.lit("")) != "").select("group_id", "room", "id", "score", F.concat(F.lit("["), F.coalesce(kind, F.lit("fact")), F.lit("] "), short).alias("line"))
    top = told.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= most).drop("_n")
    scored = top.withColumn("best", F.max("score").over(Window.partitionBy("group_id", "room")))
    nothing = {"id": F.lit(None).cast(items.schema["id"].dataType), "score": F.lit(None).cast("double")}
    header = scored.select("group_id", "room", "best").distinct().withColumns({**nothing, "line": F.concat(F.lit("\n**"), "room", F.lit(":**")), "part": F.lit(0)})
    order = Window.partitionBy("group_id").orderBy(F.desc("best"), "room", "part", F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    spent = scored.withColumn("part", F.lit(1)).unionByName(header).withColumn("spent", F.sum(F.floor(F.length("line") / 4)).over(order) + len(HEADING) // 4)
    return spent.where((F.col("spent") <= budget) & (F.col("part") == 1)).select("group_id", "room", "id", "score", "spent", "line")


def wake_up_text(woken: DataFrame) -> DataFrame:
    """(group_id, text): what ``wake_up`` took, as one text for each group."""
    placed = F.array_sort(F.collect_list(F.struct("spent", F.col("score").alias("_s"), "id", F.concat(F.lit("- "), "line").alias("line"))))
    rooms = woken.groupBy("group_id", "room").agg(F.min("spent").alias("first"), placed.alias("x"))
    block = F.concat(F.lit("\n**"), "room", F.lit(":**\n"), F.array_join(F.col("x.line"), "\n"))
    texts = rooms.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("first", block.alias("block")))).alias("x"))
    return texts.select("group_id", F.concat(F.lit(f"{HEADING}\n"), F.array_join(F.col("x.block"), "\n")).alias("text"))


def chains(links: DataFrame, depth: int = 3) -> DataFrame:
    """(session, ancestor, hops): each session and the sessions it continues, ``depth`` hops at most."""
    found = links.select(F.col("session"), F.col("session").alias("ancestor"), F.lit(0).alias("hops"))
    step = found
    for n in range(1, depth + 1):
        to = links.where("parent is not null").select(F.col("session").alias("_s"), "parent")
        step = step.join(to, F.col("ancestor") == F.col("_s")).select("session", F.col("parent").alias("ancestor"), F.lit(n).alias("hops"))
        found = found.unionByName(step)
    return found


def guarded(state: DataFrame, arriving: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(session, signature, seen_at, changed): the guard's state (session, signature, seen_at) after ``arriving`` (same columns).

    The latest signature of a session stays, ``changed`` where it differs from the one
    before; sessions not seen for ``hours`` are pruned.
    """
    top = arriving.groupBy(F.col("session").alias("_s")).agg(F.max(F.struct("seen_at", "signature")).alias("new"))
    met = state.join(top, F.col("session") == F.col("_s"), "full")
    fresh = met.select(
        F.coalesce("session", "_s").alias("session"),
        F.coalesce("new.signature", "signature").alias("signature"),
        F.coalesce("new.seen_at", "seen_at").alias("seen_at"),
        (F.col("new").isNotNull() & ~F.col("new.signature").eqNullSafe(F.col("signature"))).alias("changed"),
    )
    return fresh.where(F.col("seen_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
