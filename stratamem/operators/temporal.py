"""Two time axes: what was true, and what was believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _within(start: Column, end: Column, at: Column) -> Column:
    return at.isNull() | ((start.isNull() | (start <= at)) & (end.isNull() | (end >= at)))


def valid_at(at: Column, created: str = "created_at", start: str = "valid_from", end: str = "valid_to") -> Column:
    """True in the world at ``at``, bounds included; unknown bounds and a null time hold nothing back."""
    return _within(F.coalesce(start, created), F.col(end), at)


def known_at(at: Column, created: str = "created_at", start: str = "t_created", end: str = "t_expired") -> Column:
    """Believed at ``at``, bounds included."""
    return _within(F.coalesce(start, created), F.col(end), at)


def parse_time(text: Column) -> Column:
    """An ISO time or date in UTC; null if it can't be read, so that a filter on it keeps all."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def set_validity(records: DataFrame, changes: DataFrame, key: str = "uuid") -> DataFrame:
    """``records`` with the bounds that ``changes`` (key, new_from, new_to) set; null leaves a bound as it is."""
    changed = records.join(changes, key, "left")
    return changed.withColumns(
        {"valid_from": F.coalesce("new_from", "valid_from"), "valid_to": F.coalesce("new_to", "valid_to")}
    ).drop("new_from", "new_to")


def holding(intervals: DataFrame, anchors: DataFrame, unit: int = 3600) -> DataFrame:
    """The rows of ``intervals`` (start, end, ...) with each of ``anchors`` (at, ...) in them, both ends included; a null end is open.

    Time is cut into spans of ``unit`` seconds, and spans into a binary tree. An interval is
    written once for each of the few nodes that make it up, two a level at most, and an
    anchor once a level, so they meet by equality; times decide at the ends.
    """
    times = anchors.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    if times["a"] is None:
        return intervals.crossJoin(anchors.limit(0))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = anchors.agg(F.min(micros("at")), F.max(micros("at"))).first()
    width = unit * 1_000_000
    most = (last - first) // width
    levels = max(1, int(most).bit_length() + 1)
    place = lambda c: F.floor((micros(c) - first) / width).cast("long")
    left = F.greatest(F.lit(0), place("start"))
    right = F.least(F.lit(most), F.coalesce(place("end"), F.lit(most)))
    node = "array<struct<level: int, node: bigint>>"
    state = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"), F.array().cast(node).alias("out"))

    def climb(s: Column, level: Column) -> Column:
        take_a = (s["a"] <= s["b"]) & (s["a"] % 2 == 1)
        a = F.when(take_a, s["a"] + 1).otherwise(s["a"])
        take_b = (a <= s["b"]) & (s["b"] % 2 == 0)
        b = F.when(take_b, s["b"] - 1).otherwise(s["b"])
        one = lambda take, x: F.when(take, F.array(F.struct(level.alias("level"), x.alias("node")))).otherwise(F.array().cast(node))
        left_over = a <= b  # once nothing is left, nothing may come back
        return F.struct(F.when(left_over, F.shiftright(a, 1)).otherwise(F.lit(1)).cast("long").alias("a"), F.when(left_over, F.shiftright(b, 1)).otherwise(F.lit(-1)).cast("long").alias("b"), F.concat(s["out"], one(take_a, s["a"]), one(take_b, s["b"])).alias("out"))

    nodes = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), state, climb, lambda s: s["out"])
    written = intervals.where("start is not null").withColumn("_node", F.explode(nodes))
    asked = anchors.withColumn("_place", place("at")).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_at_node", F.expr("shiftright(_place, _level)"))
    met = written.join(asked, (F.col("_node.level") == F.col("_level")) & (F.col("_node.node") == F.col("_at_node")))
    return met.where((F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("end") >= F.col("at")))).drop("_node", "_place", "_level", "_at_node")
