"""The memory model over the test tables: episodes from events, with validity and belief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.sources.tables import table

NOW = "timestamp '2024-02-01 00:00:00'"

#: DuckDB's form of ``events``.
EVENTS_SQL = """
select event_id as uuid, user_id as group_id, event_type as memory_type, ts as created_at, ts as valid_from,
  lead(ts) over (partition by user_id, event_type order by ts, event_id) as valid_to,
  ts + interval 1 hour as t_created, ts + interval 14 day as t_expired,
  value / max(value) over () as importance, 1 - value / max(value) over () as similarity,
  count(*) over (partition by user_id, event_type) as access_count, props
from events
"""


def now() -> Column:
    """The present of the test data."""
    return F.expr(NOW.replace("timestamp", "timestamp_ntz"))


def stamp(time: Column) -> Column:
    """A time as text, alike in both engines."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Episodes: one per event; it holds until the next of its kind in the group, and is believed for two weeks."""
    rows = table(spark, d, "events")
    most = rows.agg(F.max("value").alias("most"))
    kind = Window.partitionBy("user_id", "event_type")
    return rows.crossJoin(most).select(  # one row of statistics
        F.col("event_id").alias("uuid"),
        F.col("user_id").alias("group_id"),
        F.col("event_type").alias("memory_type"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(kind.orderBy("ts", "event_id")).alias("valid_to"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("t_created"),
        (F.col("ts") + F.expr("interval 14 day")).alias("t_expired"),
        (F.col("value") / F.col("most")).alias("importance"),
        (1 - F.col("value") / F.col("most")).alias("similarity"),
        F.count(F.lit(1)).over(kind).alias("access_count"),
        "props",
    )
