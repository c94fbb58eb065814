"""Ingest of messages: the gate, type, layer and writer of each, and the pages, edges and evidence it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.functions.text import classify, detect_layer, is_significant
from stratamem.operators import extract, graph
from stratamem.sources.scratch import written


def writer(agent_id: Column, surface: Column, defaults: dict[str, str] | None = None) -> Column:
    """The writer: the one named, or the default of the surface, or ``unknown``."""
    known = F.lit(None).cast("string")
    for name, agent in (defaults or {"cli": "cli"}).items():
        known = F.when(surface == name, F.lit(agent)).otherwise(known)
    return F.coalesce(agent_id, known, F.lit("unknown"))


def record(messages: DataFrame, sessions: DataFrame, surfaces: dict[str, str] | None = None) -> DataFrame:
    """The episodes that ``messages`` (uuid, session_id, content, episode_type, group_id, agent_id, surface, importance, created_at) make.

    Messages that aren't significant make none. A missing type is classified, a missing group
    is the session's (``sessions``: session_id, group_id, episode_count) or ``unknown``.
    ``session_order`` goes on from the session's count by time and uuid; ``misrouted`` marks
    what surely belongs to another layer, which is kept all the same.
    """
    known = sessions.select(F.col("session_id").alias("_s"), F.col("group_id").alias("_g"), F.col("episode_count").alias("_n"))
    kept = messages.where(is_significant(F.col("content"))).join(known, F.col("session_id") == F.col("_s"), "left")
    kind = F.coalesce("episode_type", classify(F.col("content"))["type"])
    kept = kept.withColumns({"episode_type": kind, "group_id": F.coalesce("group_id", "_g", F.lit("unknown"))})
    layer = detect_layer(F.col("content"), F.col("episode_type"))
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "uuid")) - 1
    return kept.withColumn("layer", layer).select(
        "uuid",
        "session_id",
        "group_id",
        writer(F.col("agent_id"), F.col("surface"), surfaces).alias("agent_id"),
        "content",
        "episode_type",
        F.coalesce("importance", F.lit(0.8)).alias("importance"),
        "created_at",
        F.col("created_at").alias("t_created"),
        F.lit(0).alias("access_count"),
        (F.coalesce("_n", F.lit(0)) + turn).cast("long").alias("session_order"),
        F.col("layer.layer").alias("layer"),
        ((F.col("layer.layer") != "world_knowledge") & (F.col("layer.confidence") > V.LAYER_SURE)).alias("misrouted"),
    )


def counted(sessions: DataFrame, episodes: DataFrame) -> DataFrame:
    """``sessions`` with the new ``episodes`` counted."""
    new = episodes.groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).alias("_new"))
    met = sessions.join(new, F.col("session_id") == F.col("_s"), "left")
    return met.withColumn("episode_count", F.col("episode_count") + F.coalesce("_new", F.lit(0))).drop("_s", "_new")


def mentioned(episodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page states, edge states, evidence) of episodes, which further episodes' can be folded into.

    A page's state is the least (rank, domain) that names it: a mention before an edge's end.
    """
    references = written(extract.entity_references(episodes), "references")  # each read twice below
    found = written(extract.extract_edges(episodes, "created_at"), "edges")
    named = references.select("slug", F.struct(F.lit(0).alias("rank"), "domain").alias("named")).unionByName(found.select(F.col("to_slug").alias("slug"), F.struct(F.lit(1).alias("rank"), "domain").alias("named")))
    evidence = references.select("uuid", "slug").join(episodes.select("uuid", F.left("content", F.lit(120)).alias("summary")), "uuid").select("slug", "uuid", "summary")
    return merged_pages(named), graph.edge_states(found), evidence


def merged_pages(states: DataFrame) -> DataFrame:
    """Page states (slug, named), one for each page."""
    return states.groupBy("slug").agg(F.min("named").alias("named"))


def maintain(episodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, edges, evidence) that episodes make: pages (slug, domain) on first mention, typed edges at
    their highest confidence, and one evidence link (slug, uuid, summary) for each page and episode."""
    pages, edges, evidence = mentioned(written(episodes.select("uuid", "content", "episode_type", "group_id", "created_at"), "mentioning"))
    return pages.select("slug", F.col("named.domain").alias("domain")), graph.told_edges(edges), evidence


def open_sessions(sessions: DataFrame, arriving: DataFrame) -> DataFrame:
    """``sessions`` (session_id, group_id, started_at, ended_at, episode_count, parent) with those of ``arriving`` (session_id, group_id, started_at).

    A new session continues the latest one of its group that started before it.
    """
    both = sessions.select("session_id", "group_id", "started_at", F.lit(False).alias("new")).unionByName(arriving.select("session_id", "group_id", "started_at", F.lit(True).alias("new")))
    before = F.lag("session_id").over(Window.partitionBy("group_id").orderBy("started_at", "session_id"))
    new = both.withColumn("parent", before).where("new").drop("new")
    return sessions.unionByName(new.select("session_id", "group_id", "started_at", F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit(0).cast("long").alias("episode_count"), "parent"), allowMissingColumns=True)


def end_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """``sessions`` with ``ended_at`` from ``ended`` (session_id, ended_at) where they were open."""
    marks = ended.groupBy(F.col("session_id").alias("_s")).agg(F.min("ended_at").alias("_at"))
    met = sessions.join(marks, F.col("session_id") == F.col("_s"), "left")
    return met.withColumn("ended_at", F.coalesce("ended_at", "_at")).drop("_s", "_at")
