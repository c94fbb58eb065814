"""Requests that repeat a key: one is accepted if the last accepted one of its key is long enough ago."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds for which an accepted request answers for those that repeat its key.
WINDOW = 3600


def answered(requests: DataFrame, seconds: int = WINDOW) -> DataFrame:
    """(key, id, at, by): which request answers each of ``requests`` (key, id, at, and ``accepted`` if some were before).

    A key's first request is accepted, and each that comes over ``seconds`` after the last
    accepted one; the others are answered by that. Of equal times those accepted before come
    first, then the least id.

    What is accepted hangs on all before it, but not across a silence of over ``seconds``. So
    keys are cut there: spans of ``seconds`` with their first and last time, one row for each
    key and span, tell where, and each stretch between two silences is passed through in order
    with one request in memory. A null key is always accepted; rows without a time never are.
    """
    width = F.lit(seconds * 1_000_000)
    before = F.coalesce("accepted", F.lit(False)) if "accepted" in requests.columns else F.lit(False)
    rows = requests.select("key", "id", "at", before.alias("_old"), F.unix_micros("at").alias("_t")).where("at is not null")
    keyed = rows.where("key is not null").withColumn("_span", F.floor(F.col("_t") / width))
    spans = keyed.groupBy("key", "_span").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    order = Window.partitionBy("key").orderBy("_span")
    fresh = (F.col("_first") - F.lag("_last").over(order) > width).cast("int")
    stretch = spans.withColumn("_fresh", F.coalesce(fresh, F.lit(1))).withColumn("_stretch", F.sum("_fresh").over(order))
    stretch = stretch.select(F.col("key").alias("_k"), F.col("_span").alias("_s"), "_stretch")
    dealt = keyed.join(stretch, (F.col("key") == F.col("_k")) & (F.col("_span") == F.col("_s"))).select("key", "_stretch", "_t", (~F.col("_old")).alias("_new"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, by = None, 0, None
        for batch in batches:
            answers = []
            for key, stretch_no, t, new, i in zip(batch["key"], batch["_stretch"], batch["_t"], batch["_new"], batch["id"], strict=True):
                if not new or (key, stretch_no) != at or t - last > seconds * 1_000_000:
                    at, last, by = (key, stretch_no), t, i
                answers.append(by)
            yield batch[["key", "id", "_t"]].assign(by=answers)

    in_order = dealt.repartition("key", "_stretch").sortWithinPartitions("key", "_stretch", "_t", "_new", "id")
    id_type = requests.schema["id"].dataType.simpleString()
    found = in_order.mapInPandas(run, f"key {requests.schema['key'].dataType.simpleString()}, id {id_type}, _t long, by {id_type}")
    return found.select("key", "id", F.timestamp_micros("_t").alias("at"), "by").unionByName(rows.where("key is null").select("key", "id", "at", F.col("id").alias("by")))


def first_accepted(requests: DataFrame, seconds: int = WINDOW) -> DataFrame:
    """(key, id, at) of the ``requests`` (key string, id long, at timestamp) that ``answered`` accepts."""
    return answered(requests, seconds).where("id = by").drop("by")
