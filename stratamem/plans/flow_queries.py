"""Registered queries: ingest, sessions, snapshots, digests, audits, deletions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.functions import forms, guard
from stratamem.operators import compaction, handoff, ingest, lifecycle, sessions
from stratamem.plans import memory_queries as M
from stratamem.plans.catalogue import ORACLES, register
from stratamem.plans.model import EVENTS_SQL, NOW, events, now, stamp
from stratamem.sources import sinks
from stratamem.sources.scratch import shared_folder
from stratamem.sources.tables import table
from stratamem.streaming import queries as Q


def _messages(events: DataFrame) -> DataFrame:
    """Messages of one session per user; every third comes from the command line."""
    return events.select(
        F.col("event_id").alias("uuid"),
        F.col("user_id").alias("session_id"),
        F.expr(M._note_sql("event_type", "cast(user_id as string)")).alias("content"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("episode_type"),
        F.when(F.col("event_id") % 5 == 0, F.lit("own")).alias("group_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("cron")).alias("agent_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit("cli")).otherwise(F.lit("hooks")).alias("surface"),
        F.lit(None).cast("double").alias("importance"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.concat(F.lit("nation-"), "c_nationkey").alias("group_id"), F.lit(10).alias("episode_count"))


_INGEST = f"""with m as (select event_id as uuid, user_id as session_id, {M._note_sql('event_type', 'user_id::varchar')} as content, event_type, ts from events),
  k as (select *, lower(content) as low from m where length(content) >= {V.SIGNIFICANT_CHARS} and {M._any('lower(content)', V.SIGNIFICANT_KEYWORDS)}),
  t as (select *, {M._TYPE_CASE} as first from k)
  select uuid, session_id, case when uuid % 5 = 0 then 'own' when c_custkey is not null then 'nation-' || c_nationkey else 'unknown' end as group_id,
    case when uuid % 7 = 0 then 'cron' when uuid % 3 = 0 then 'cli' else 'unknown' end as agent_id,
    case when uuid % 2 = 0 then event_type when first in ('question', 'hypothesis') and {M._any('low', V.RESOLUTION_KEYWORDS)} then 'outcome' else first end as episode_type,
    case when c_custkey is null then 0 else 10 end + row_number() over (partition by session_id order by ts, uuid) - 1 as session_order
  from t left join customer on c_custkey = session_id"""
_INGESTED = ["uuid", "session_id", "group_id", "agent_id", "episode_type", "session_order"]


@register("ingest_episodes", _INGEST)
def ingest_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Messages through the gate, with type, group, writer and place in the session."""
    return ingest.record(_messages(table(spark, d, "events")), _sessions(spark, d)).select(*_INGESTED)


def _streamed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    root = f"{shared_folder(spark)}/stratamem/ingest-{uuid.uuid4().hex}"
    Q.ingest(Q.in_slices(_messages(table(spark, d, "events")), "created_at", 4), _sessions(spark, d), root, compact_every=3)
    return Q.ingested(spark, root)


@register("stream_ingest", _INGEST)
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream of four micro-batches: sessions go on where the batch before left them."""
    return _streamed(spark, d)["episodes"].select(*_INGESTED)


@register("ingest_pages")
def ingest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that new episodes make, each under one domain."""
    pages, _, _ = ingest.maintain(ingest.record(_messages(table(spark, d, "events")), _sessions(spark, d)))
    return pages


@register(
    "session_opening",
    "with s as (select o_orderkey as session_id, o_custkey as group_id, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent from orders) select session_id, group_id, case when session_id % 4 = 0 then parent end as parent, case when session_id % 4 <> 0 and session_id % 3 = 0 then '2024-02-01 00:00:00' end as ended_at from s",
)
def session_opening(spark: SparkSession, d: str) -> DataFrame:
    """B2: sessions opened after the latest of their group, and others ended."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderdate").alias("started_at"))
    kept = {"ended_at": F.lit(None).cast("timestamp_ntz"), "episode_count": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")}
    found = ingest.open_sessions(orders.where("session_id % 4 <> 0").withColumns(kept), orders.where("session_id % 4 = 0"))
    ended = orders.where("session_id % 4 <> 0 and session_id % 3 = 0").select("session_id", now().alias("ended_at"))
    return ingest.end_sessions(found, ended).select("session_id", "group_id", "parent", stamp(F.col("ended_at")).alias("ended_at"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "text")
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    return said.select("conv_id", F.array_join("x.text", "\n").alias("summary")).withColumns(forms.from_summary(F.col("summary")))


@register("snapshot_cap")
def snapshot_cap(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's snapshot, its lists cut until it fits, and what it takes."""
    out = forms.capped(_snapshots(spark, d))
    return out.select("conv_id", "task", *(F.size(n).alias(n) for n in forms.LISTS), forms.snapshot_length().cast("long").alias("characters"))


@register("context_blocks")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The block that opens the next session."""
    return forms.capped(_snapshots(spark, d)).select("conv_id", forms.context_block(F.lit("desk")).alias("block"))


@register("rerank_texts", "select doc_id as id, substr(coalesce(case when doc_id % 3 = 0 then null when trim(regexp_replace(text, '\\s', ' ', 'g')) <> '' then text end, case when doc_id % 2 = 0 and trim(source) <> '' then source end, lang, ''), 1, 1500) as text from documents")
def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that a reranker reads of each hit."""
    fields = [F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang"), F.lit(None).cast("string"), F.lit(" ")]
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), forms.rerank_text(*fields).alias("text"))


@register("archive_stale", f"select o_orderkey as uuid, case when coalesce({M._STATES}, 'active') in ('active', 'confirmed') and o_orderdate < {NOW} - interval 9000 day then 'archived' else {M._STATES} end as lifecycle_status from orders")
def archive_stale(spark: SparkSession, d: str) -> DataFrame:
    """What was left alone too long, archived."""
    return lifecycle.archive_stale(M._records(spark, d), now(), 9000).select("uuid", "lifecycle_status")


@register("lifecycle_wishes", f"with r as (select o_orderkey as uuid, {M._STATES} as s, case o_orderkey % 3 when 0 then 'confirmed' when 1 then 'contradicted' else 'active' end as w from orders), x as (select *, ({M._ALLOWED}) as ok from r) select uuid, case when ok then w else coalesce(s, 'active') end as new_status, ok as accepted from x")
def lifecycle_wishes(spark: SparkSession, d: str) -> DataFrame:
    """Records confirmed, contradicted or restored, where their state allows it."""
    records = M._records(spark, d).drop("wanted")
    wish = F.when(F.col("uuid") % 3 == 0, "confirm").when(F.col("uuid") % 3 == 1, "contradict").otherwise("restore")
    asked = lifecycle.wishes(records, records.select("uuid", wish.alias("wish")))
    return lifecycle.transition(records, asked, now()).select("uuid", "new_status", "accepted")


def _digest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("uuid"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("group"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), F.col("text").alias("content"))
    given = {"created_at": now() - F.make_dt_interval(mins=F.pmod("uuid", F.lit(1440)).cast("int")), "lifecycle_status": F.lit(None).cast("string"), "daily_run": F.lit(None).cast("string")}
    memories = vectors.join(docs, "uuid").withColumns(given)
    return memories, compaction.daily_digest(memories, now(), least=M._NEAR)


@register("daily_digest")
def daily_digest(spark: SparkSession, d: str) -> DataFrame:
    """Copies merged, then near memories of those left."""
    return _digest(spark, d)[1]


@register(
    "nightly_audit",
    f"select 'citations' as phase, count(*) as found from ({ORACLES['citation_audit']}) where broken <> '' union all select 'orphans', count(*) from documents where doc_id not in (select doc_id from labels) union all select 'stale_edges', count(*) from ({ORACLES['stale_edges']})",
)
def nightly_audit(spark: SparkSession, d: str) -> DataFrame:
    """The three audits of a night, counted."""
    orphans = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return compaction.nightly(M.citation_audit(spark, d).where("broken <> ''"), orphans, M.stale_edges(spark, d))


@register("delete_namespace", "select o_orderkey as id, l_linenumber as line from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority <> '1-URGENT'")
def delete_namespace(spark: SparkSession, d: str) -> DataFrame:
    """What is left of nodes and edges when a group goes."""
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("group_id"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_orderkey").alias("to_id"), F.col("l_linenumber").alias("line"))
    left = sinks.delete_namespace({"nodes": nodes, "edges": edges}, "1-URGENT")
    return left["edges"].select(F.col("from_id").alias("id"), "line")


@register("schema_plan", "select 'index' as kind, event_type as name from events group by 2 except select 'index', 'click'")
def schema_plan(spark: SparkSession, d: str) -> DataFrame:
    """The constraints and indexes that are wanted and not there; applied, undone and planned again."""
    wanted = table(spark, d, "events").select(F.lit("index").alias("kind"), F.col("event_type").alias("name")).distinct()
    there = wanted.where("name = 'click'")
    planned = sinks.plan_schema(wanted, there, ["kind", "name"])
    applied = sinks.apply_schema(there, planned)
    return sinks.plan_schema(wanted, sinks.apply_schema(applied, planned, undo=True), ["kind", "name"])


@register("vector_store", "select count(*) as n, count(distinct label) as labels from embeddings where vec_id % 10 <> 0")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """What a vector table holds after some are written over and some deleted."""
    rows = table(spark, d, "embeddings")
    put = sinks.rewrite_by_key(rows, rows.where("vec_id % 10 = 1"), ["vec_id"])
    left = sinks.delete_by_key(put, rows.where("vec_id % 10 = 0"), ["vec_id"])
    return left.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"))


@register("reindex_stats", f"with t as (select doc_id, length({M._STRIP.format('text')}) as n from documents) select count(*) as seen, count(*) filter (where n >= 10) as indexed, count(*) filter (where n < 10 or n is null) as skipped from t")
def reindex_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a full reindex takes in and leaves out."""
    from stratamem.functions.text import strip

    long = F.coalesce(F.length(strip(F.col("text"))) >= 10, F.lit(False))
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("seen"), F.count_if(long).alias("indexed"), F.count_if(~long).alias("skipped"))


@register("watched_handoffs", f"with e as ({EVENTS_SQL}) select group_id, max_by(uuid, (created_at, uuid)) as uuid from e where created_at >= {NOW} - interval 72 hour and group_id in (select c_custkey from customer where c_acctbal > 0) group by 1")
def watched_handoffs(spark: SparkSession, d: str) -> DataFrame:
    """The latest handoff of each watched group in three days, in one pass."""
    watched = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("group_id"))
    recent = events(spark, d).where(F.col("created_at") >= now() - F.expr("interval 72 hour")).join(watched, "group_id", "left_semi")
    return recent.groupBy("group_id").agg(F.max(F.struct("created_at", "uuid")).alias("x")).select("group_id", "x.uuid")


@register(
    "guard_state",
    f"""with s as (select user_id as session, max_by(event_type, (ts, event_type)) as signature, max(ts) as seen_at from events where event_id % 2 = 0 group by 1), n as (select user_id as session, max_by(event_type, (ts, event_type)) as signature, max(ts) as seen_at from events where event_id % 2 = 1 group by 1)
    select coalesce(s.session, n.session) as session, coalesce(n.signature, s.signature) as signature, n.session is not null and n.signature is distinct from s.signature as changed from s full join n on n.session = s.session where coalesce(n.seen_at, s.seen_at) >= {NOW} - interval 72 hour""",
)
def guard_state(spark: SparkSession, d: str) -> DataFrame:
    """Signatures compared with the session's last, old sessions pruned."""

    def seen(rows: DataFrame) -> DataFrame:
        top = F.max(F.struct("ts", "event_type")).alias("x")
        return rows.groupBy(F.col("user_id").alias("session")).agg(top).select("session", F.col("x.event_type").alias("signature"), F.col("x.ts").alias("seen_at"))

    rows = table(spark, d, "events")
    return sessions.guarded(seen(rows.where("event_id % 2 = 0")), seen(rows.where("event_id % 2 = 1")), now(), 72).drop("seen_at")


@register("timeline_slugs", "select role as slug from conversations union select event_type from events union select lang from documents where lang is not null")
def timeline_slugs(spark: SparkSession, d: str) -> DataFrame:
    """The slugs of all timelines, as one set."""
    parts = [table(spark, d, t).select(F.col(c).alias("slug")) for t, c in (("conversations", "role"), ("events", "event_type"), ("documents", "lang"))]
    return parts[0].union(parts[1]).union(parts[2]).where("slug is not null").distinct()


@register("response_envelopes", "select event_id as id, 2 as version, 'ok' as status, event_type as kind, 0 as warnings from events")
def response_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Each answer in the locked shape."""
    shaped = table(spark, d, "events").select("event_id", guard.envelope(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("e"))
    return shaped.select("e.data.id", "e.version", "e.status", "e.data.kind", F.size("e.warnings").alias("warnings"))


@register("backfill_rollback", f"with e as ({EVENTS_SQL}) select 'valid_to' as column, count(*) filter (where valid_to is null) as before, 0 as after_fill, count(*) filter (where valid_to is null) as after_undo from e")
def backfill_rollback(spark: SparkSession, d: str) -> DataFrame:
    """What a backfill would fill, has left to fill, and gives back when undone."""
    rows = events(spark, d).select("uuid", "valid_to")
    filled = sinks.backfill(rows, "valid_to", now())
    undone = sinks.undo_backfill(filled, "valid_to", rows.where("valid_to is null"), ["uuid"])
    counts = [sinks.pending(x, ["valid_to"]).withColumnRenamed("pending", name) for x, name in ((rows, "before"), (filled, "after_fill"), (undone, "after_undo"))]
    return counts[0].join(counts[1], "column").join(counts[2], "column")


_HANDOFFS = "with r as (select o_orderkey as id, o_custkey % 50 as g, o_orderpriority as k, o_orderdate as ts, min(o_orderkey) over (partition by o_custkey % 50, o_orderpriority, o_orderdate) as first from orders)"


@register("handoff_save", f"{_HANDOFFS} select id as request_id, first as answered_by, id <> first as hit from r")
def handoff_save(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs saved in two batches, the second of which repeats some of the first; which request made the handoff each gets."""
    store = handoff.tables(spark, f"{shared_folder(spark)}/stratamem/handoffs-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders")
    asked = orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("g"), (F.col("o_custkey") % 50).cast("string")).alias("group_id"),
        F.col("o_orderkey").cast("string").alias("session_id"),
        F.concat(F.lit("ship order "), F.col("o_orderkey").cast("string")).alias("task"),
        F.to_json(F.struct("o_totalprice")).alias("data"),
        F.col("o_orderpriority").alias("idempotency_key"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=F.lit(0))).alias("at"),
    )
    # of equal times the least id comes first; the ids of requests are what the handoffs' follow from
    first = asked.groupBy("group_id", "idempotency_key", "at").agg(F.min("request_id").alias("request_id"))
    handoff.save(store, asked.join(first.select("request_id"), "request_id", "left_semi"))
    found = handoff.save(store, asked)
    made = store.read("episodes").select("episode_id", F.col("request_id").alias("answered_by"))
    return found.join(made, "episode_id").select("request_id", "answered_by", (F.col("request_id") != F.col("answered_by")).alias("hit"))


@register("digest_runs", "with d as (select doc_id as uuid, doc_id % 7 as g, lower(trim(text)) as t from documents) select uuid, case when min(uuid) over (partition by g, t) <> uuid then min(uuid) over (partition by g, t) end as merged_into from d")
def digest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Copies that two runs of the digest mark, the second of which reads what came since and what it touches."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), (F.col("doc_id") % 7).alias("group"), F.trim(F.coalesce("text", F.lit(""))).alias("content"), F.lit(None).cast("array<double>").alias("vector"), F.timestamp_seconds("doc_id").alias("created_at"))
    store = compaction.digest_store(spark, f"{shared_folder(spark)}/stratamem/digest-{uuid.uuid4().hex}")
    half = docs.agg(F.max("uuid")).first()[0]
    for run, part in enumerate((docs.where(F.col("uuid") * 2 < half), docs.where(F.col("uuid") * 2 >= half))):
        compaction.digest_batch(store, part, run)
    return store.read("markers").select("uuid", "merged_into")
