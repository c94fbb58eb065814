"""Structured Streaming forms: dedupe within a window, session windows, latest per group."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratamem.operators import graph
from stratamem.operators.ingest import mentioned, merged_pages, record
from stratamem.sources.delta import DeltaTables, kept_first, kept_last
from stratamem.sources.scratch import shared_folder, written
from stratamem.streaming.leases import PROVIDER


def table_stream(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """The Parquet table, a file or a folder of files, as a stream."""
    place = f"{path.rstrip('/')}/{table_name}.parque"
    # as a pattern, since a stream takes the name of a file for a folder's
    return spark.readStream.schema(spark.read.parquet(f"{place}t").schema).parquet(f"{place}[t]")


def event_stream(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """The Parquet table as a stream, its wall-clock times as UTC instants."""
    return table_stream(spark, path, table_name).withColumn("ts", F.col("ts").cast("timestamp"))


def in_slices(rows: DataFrame, time: str, slices: int, files: int = 4) -> DataFrame:
    """``rows`` as a stream of ``slices`` micro-batches, one for each equal span of ``time``.

    Each span is written to the shared folder in ``files`` files, one span after the other, and
    a micro-batch takes as many; so batches come in the order of time, as from a live source.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stratamem/slices-{uuid.uuid4().hex}"
    rows, at = written(rows, "sliced"), F.unix_micros(F.col(time).cast("timestamp"))
    least, most = rows.select(F.min(at), F.max(at)).first()
    for n in range(slices):
        since, until = (least + (most - least + 1) * k // slices for k in (n, n + 1)) if least is not None else (0, 0)
        rows.where((at >= since) & (at < until)).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, mode: str, empty_batches: bool = True) -> DataFrame:
    """What the stream yields from all data there is now, as a table; in complete mode the last state.

    ``empty_batches`` let event-time timers fire at the end; with state that lives by
    processing time they would go on forever.

    Each micro-batch is written as Parquet in the shared folder, where the query keeps its
    checkpoint too; a batch that is run again writes over itself. Nothing goes to the driver.
    """
    root = f"{shared_folder(stream.sparkSession)}/stratamem/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        batches.append(batch)

    spark, setting = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(empty_batches).lower())
    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    paths = [f"{root}/rows/batch={n}" for n in (sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches)))]
    if not paths:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*paths)


#: Micro-batches after which the tables of ``ingest`` are compacted.
COMPACT_EVERY = 16


def ingest_tables(spark: SparkSession, root: str) -> DeltaTables:
    """What ``ingest`` keeps: episodes, states of pages and edges, evidence, and how many episodes each session has."""

    def last(rows: DataFrame, merge) -> DataFrame:
        return merge(rows).withColumn("version", F.lit(0).cast("long"))

    merges = {
        "episodes": None,
        "pages": lambda rows: last(rows, merged_pages),
        "edges": lambda rows: last(rows, graph.merged_states),
        "evidence": kept_first(["slug", "uuid"]),
        "counters": kept_last(["session_id"]),
    }
    return DeltaTables(spark, root, merges)


def ingest_batch(tables: DeltaTables, sessions: DataFrame, rows: DataFrame, batch: int) -> None:
    """Record one micro-batch: sessions go on from the counters of the batches before it, so it can be run again."""
    counters = tables.read("counters", before=batch)
    if counters is not None:
        so_far = counters.select(F.col("session_id").alias("_s"), F.col("episodes").alias("_n"))
        met = sessions.join(so_far, F.col("session_id") == F.col("_s"), "full")
        sessions = met.select(F.coalesce("session_id", "_s").alias("session_id"), "group_id", F.coalesce("_n", "episode_count").alias("episode_count"))
    episodes = written(record(rows, sessions), "episodes")
    pages, edges, evidence = mentioned(episodes)
    counted = episodes.groupBy("session_id").agg((F.max("session_order") + 1).alias("episodes"))
    tables.commit(batch, {"episodes": episodes, "pages": pages, "edges": edges, "evidence": evidence, "counters": counted})


def ingest(stream: DataFrame, sessions: DataFrame, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """Messages as they come, each micro-batch recorded and committed as one below ``root``.

    ``stream`` has the columns of ``operators.ingest.record``. Batches in the order of time
    give what one batch of all messages would: a session's numbers go on where they were, a
    page or edge that is met again is merged. A batch that is run again replaces itself.
    """
    tables = ingest_tables(stream.sparkSession, root)

    def write(rows: DataFrame, batch: int) -> None:
        ingest_batch(tables, sessions, rows, batch)
        if batch % compact_every == compact_every - 1:
            tables.compact(batch)  # not the batch itself, which may come again

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that ``ingest`` has made below ``root``, as ``operators.ingest.maintain`` has them."""
    tables = ingest_tables(spark, root)
    return {
        "episodes": tables.read("episodes").drop("version"),
        "pages": tables.read("pages").select("slug", F.col("named.domain").alias("domain")),
        "edges": graph.told_edges(tables.read("edges")),
        "evidence": tables.read("evidence").drop("version"),
        "counters": tables.read("counters").drop("version"),
    }


def first_of_key(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each key once within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class LastAccepted(StatefulProcessor):
    """One key: when its last request was accepted, until the watermark is so far that it answers for none."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _ends(self, last: int) -> int:
        return (last + self.micros) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = last = self.last.get()[0] if self.last.exists() else None
        batch, kept = pd.concat(list(rows)).sort_values(["at", "id"], ignore_index=True), []
        for n, at in enumerate(batch["at"].astype("datetime64[us]").astype("int64").tolist()):
            if last is None or at - last > self.micros:
                last = at
                kept.append(n)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))
            self.last.update((last,))
        if kept:
            yield batch.loc[kept, ["key", "id", "at"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def accepted_of_key(stream: DataFrame, seconds: int, delay: str) -> DataFrame:
    """``operators.idempotency.first_accepted`` of a stream (key, id, at) whose keys aren't null, late by ``delay`` at most."""
    stream.sparkSession.conf.set(*PROVIDER)
    id_type = stream.schema["id"].dataType.simpleString()
    return stream.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(LastAccepted(seconds), f"key string, id {id_type}, at timestamp", "append", "EventTime")


def session_windows(stream: DataFrame, keys: list[str], gap: str, *aggregates: Column) -> DataFrame:
    """Sessions of events that follow each other within ``gap``."""
    return stream.groupBy(*keys, F.session_window("ts", gap).alias("session")).agg(*aggregates)


def latest_per_group(stream: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """Running latest row per group."""
    return stream.groupBy(*keys).agg(*columns)


class FirstReply(StatefulProcessor):
    """One session: whether its first reply was judged, forgotten ``keep_ms`` after that."""

    def __init__(self, keyword: str, keep_ms: int | None):
        self.keyword, self.keep_ms = keyword, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.judged = handle.getValueState("judged", "judged boolean", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.judged.exists():
            batch = pd.concat(list(rows))
            replies = batch[batch["role"] == "assistant"].sort_values("turn")
            if len(replies):
                self.judged.update((True,))
                yield pd.DataFrame({"conv_id": [key[0]], "violation": [self.keyword not in (replies["text"].iloc[0] or "").lower()]})

    def close(self) -> None:
        pass


def first_replies(stream: DataFrame, keyword: str, keep_ms: int | None = None) -> DataFrame:
    """(conv_id, violation) once per session, when its first reply comes: it does not take up ``keyword``.

    ``stream`` has conv_id, turn, role, text. A session's state is whether its reply was
    judged; with ``keep_ms`` the state store drops it that long after, by processing time.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    mode = "None" if keep_ms is None else "ProcessingTime"
    return stream.groupBy("conv_id").transformWithStateInPandas(FirstReply(keyword, keep_ms), "conv_id long, violation boolean", "append", mode)


def expired_leases(stream: DataFrame, until: str) -> DataFrame:
    """Jobs (job_id, claimed_at, timeout_seconds) whose lease of twice their timeout ended before the time ``until``."""
    end = F.col("claimed_at") + F.make_dt_interval(secs=(2 * F.col("timeout_seconds")).cast("decimal(18,6)"))
    return stream.where(end < F.lit(until).cast("timestamp"))
