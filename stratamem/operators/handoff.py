"""Handoffs: snapshot, episode, edges and the end of the session, all seen together or not at all, once for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.operators.idempotency import WINDOW, answered
from stratamem.sources.delta import DeltaTables, kept_last
from stratamem.sources.scratch import written

TABLES = ("snapshots", "episodes", "edges", "sessions")


def tables(spark: SparkSession, root: str) -> DeltaTables:
    """Where handoffs are kept below ``root``."""
    return DeltaTables(spark, root, {"snapshots": None, "episodes": None, "edges": None, "sessions": kept_last(["session_id"])})


def _deltas(new: DataFrame) -> dict[str, DataFrame]:
    """What accepted requests write."""
    name = F.concat(F.lit("[HANDOFF] "), F.left("task", F.lit(80)))
    edge = lambda kind, to: new.select(F.col("session_id").alias("from_id"), F.lit(kind).alias("edge_type"), to.alias("to_id"), "at")
    return {
        "snapshots": new.select("snapshot_id", "session_id", "group_id", "data", "idempotency_key", F.col("at").alias("created_at")),
        "episodes": new.select("episode_id", "session_id", "group_id", F.concat(F.lit("[HANDOFF] "), "task").alias("content"), name.alias("name"), F.lit("handoff").alias("memory_type"), "idempotency_key", "snapshot_id", F.col("at").alias("created_at"), "request_id"),
        "edges": edge("HAS_SNAPSHOT", F.col("snapshot_id")).unionByName(edge("PRODUCED_HANDOFF", F.col("episode_id"))),
        "sessions": new.groupBy("session_id").agg(F.max("at").alias("ended_at"), F.lit("handoff").alias("status")),
    }


def save(store: DeltaTables, requests: DataFrame, seconds: int = WINDOW, tries: int = 10, before_commit=None) -> DataFrame:
    """(request_id, episode_id, snapshot_id, session_id, hit) for ``requests`` (request_id, group_id, session_id, task, data, idempotency_key, at).

    A request whose key its group had accepted within ``seconds`` gets that handoff's ids, a
    ``hit``; any other is accepted. All a batch writes is one version, committed if no other
    writer has taken it meanwhile; else the requests are judged anew against what that one
    wrote. Ids follow from the request, so a batch that is sent again gives the same ones.
    """
    requests = written(requests, "handoffs")
    key = F.when(F.col("idempotency_key").isNotNull(), F.to_json(F.struct("group_id", "idempotency_key")))
    made = lambda kind: F.left(F.sha2(F.concat_ws("\n", F.lit(kind), "group_id", F.col("request_id").cast("string"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256), F.lit(32))
    requests = requests.withColumns({"_key": key, "snapshot_id": made("snapshot"), "episode_id": made("episode")})
    for _ in range(tries):
        version = store.next_version()
        known = store.read("episodes", before=version)
        asked = requests.select(F.col("_key").alias("key"), F.col("episode_id").alias("id"), "at", F.lit(False).alias("accepted"))
        if known is not None:
            asked = asked.unionByName(known.select(key.alias("key"), F.col("episode_id").alias("id"), F.col("created_at").alias("at"), F.lit(True).alias("accepted")))
        answers = written(answered(asked, seconds).select(F.col("id").alias("_id"), F.col("by").alias("_by")).distinct(), "answers")
        found = requests.join(answers, F.col("episode_id") == F.col("_id"))
        new = found.where("_by = episode_id")
        if known is not None:
            new = new.join(known.select("episode_id"), "episode_id", "left_anti")
        new = written(new, "accepted")
        if before_commit is not None:
            before_commit()
        if not new.limit(1).count() or store.commit_if_absent(version, _deltas(new)):
            every = store.read("episodes")
            if every is None:  # nothing asked, nothing kept
                return found.select("request_id", "episode_id", "snapshot_id", "session_id", F.lit(False).alias("hit"))
            kept = every.select(F.col("episode_id").alias("_e"), F.col("snapshot_id").alias("_s"), F.col("session_id").alias("_session"))
            mine = new.select(F.col("request_id").alias("_r")).distinct()
            met = found.join(kept, F.col("_by") == F.col("_e")).join(mine, F.col("request_id") == F.col("_r"), "left")
            return met.select("request_id", F.col("_e").alias("episode_id"), F.col("_s").alias("snapshot_id"), F.col("_session").alias("session_id"), F.col("_r").isNull().alias("hit"))
    raise RuntimeError(f"other writers took {tries} versions in a row")
