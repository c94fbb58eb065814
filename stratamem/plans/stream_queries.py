"""Registered queries: Structured Streaming, run over all data there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.operators.idempotency import WINDOW, first_accepted
from stratamem.plans.catalogue import register
from stratamem.sources.tables import table
from stratamem.streaming import leases
from stratamem.streaming import queries as Q


@register("stream_dedupe", "select distinct user_id, event_type, ts::date::varchar as day from events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """K3: each key of a day once."""
    stream = Q.event_stream(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    once = Q.first_of_key(stream.select("user_id", "event_type", "day", "ts"), ["user_id", "event_type", "day"], "40 days")
    return Q.run_available(once.select("user_id", "event_type", "day"), "append")


@register(
    "stream_session_windows",
    "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, session",
)
def stream_session_windows(spark: SparkSession, d: str) -> DataFrame:
    """K5: sessions of events less than six hours apart."""
    found = Q.session_windows(Q.event_stream(spark, d, "events"), ["user_id"], "6 hours", F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return Q.run_available(found.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "complete")


@register("stream_latest_handoff", "select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def stream_latest_handoff(spark: SparkSession, d: str) -> DataFrame:
    """K4: the latest event of each user."""
    top = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    found = Q.latest_per_group(Q.event_stream(spark, d, "events"), ["user_id"], top)
    return Q.run_available(found.select("user_id", "x.event_id", "x.event_type"), "complete")


@register(
    "stream_first_replies",
    "with r as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'assistant') select conv_id, not contains(lower(text), 'handoff') as violation from r where n = 1",
)
def stream_first_replies(spark: SparkSession, d: str) -> DataFrame:
    """Keyed state per session, kept for 24 hours: whether its first reply took up the handoff."""
    stream = Q.table_stream(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return Q.run_available(Q.first_replies(stream, "handoff", 24 * 3600 * 1000), "append", empty_batches=False)


@register("stream_expired_leases", "select o_orderkey as job_id from orders where o_orderstatus = 'P' and o_orderdate + to_seconds(2 * cast(o_totalprice as int)) < timestamp '1996-06-01'")
def stream_expired_leases(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs of a stream whose lease ran out."""
    jobs = Q.table_stream(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("claimed_at"), F.bround("o_totalprice").cast("int").alias("timeout_seconds")
    )
    return Q.run_available(Q.expired_leases(jobs, "1996-06-01 00:00:00").select("job_id"), "append")


_KINDS = {"view": "claim", "signup": "claim", "click": "renew", "purchase": "complete", "error": "fail"}
_TIMERS = f"""
with e as (select event_id, user_id as job_id, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _KINDS.items())} end as kind, (epoch_us(ts) // 1000) as tm, 'w' || event_id % 2 as worker_id, (event_id % 5 + 1) * 10800 as timeout, max((epoch_us(ts) // 1000)) over () - 3600000 as passed from events),
a as (select *, sum((kind = 'claim')::int) over (partition by job_id order by tm, event_id) as attempts, max(tm) over (partition by job_id) as last_at from e),
o as (select *, max(worker_id) filter (where kind = 'claim') over w as owner, 2000 * max(timeout) filter (where kind = 'claim') over w as lasts, max(tm) filter (where kind = 'claim') over w as claimed_at from a where attempts > 0 window w as (partition by job_id, attempts)),
n as (select distinct job_id, attempts - 1 as attempts, claimed_at as next_claim from o),
k as (select o.*, next_claim, row_number() over w as seq, lead(tm) over w as next_at from o left join n using (job_id, attempts) where kind = 'claim' or worker_id = owner window w as (partition by job_id, attempts order by tm, event_id)),
t as (select *, min(seq) filter (where kind in ('complete', 'fail')) over (partition by job_id, attempts) as ended from k),
x as (select *, kind in ('claim', 'renew') and coalesce(next_at, next_claim, tm + lasts + 1) > tm + lasts as out from t where ended is null or seq <= ended),
f as (select *, min(seq) filter (where out) over (partition by job_id, attempts) as lost, tm + 1000 * least(3600, 5 * pow(2, least(attempts - 1, 20)))::bigint as due from x),
r as (select job_id, 'expired' as event, tm + lasts as fires, owner as worker_id, attempts, last_at, passed from f where seq = lost
  union all select job_id, 'due', due, null, attempts, last_at, passed from f where kind = 'fail' and lost is null and attempts < 12 and coalesce(next_claim, due + 1) > due)
select job_id, event, strftime(make_timestamp(fires * 1000), '%Y-%m-%d %H:%M:%S') as "at", worker_id, attempts::bigint as attempts from r where last_at > fires or fires <= passed
"""


@register("stream_queue_timers", _TIMERS)
def stream_queue_timers(spark: SparkSession, d: str) -> DataFrame:
    """Leases that run out and retries that come due, fired by timers over four micro-batches."""
    kind = F.lit(None).cast("string")
    for name, event in _KINDS.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    rows = table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        kind.alias("kind"),
        F.col("ts").cast("timestamp").alias("at"),
        F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker_id"),
        ((F.col("event_id") % 5 + 1) * 10800).cast("int").alias("timeout_seconds"),
        F.lit(12).alias("max_attempts"),
    )
    fired = Q.run_available(leases.queue_timers(Q.in_slices(rows, "at", 4), "1 hour"), "append")
    return fired.select("job_id", "event", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "worker_id", F.col("attempts").cast("long").alias("attempts"))


_ACCEPTED = """
with recursive e as (select event_type || user_id % 3 as key, event_id, ts from events),
a as (select key, min(ts) as ts from e group by key
  union all select a.key, min(e.ts) from a join e on e.key = a.key and e.ts > a.ts + interval 1 hour group by a.key)
select key, min(event_id) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as "at" from a join e using (key, ts) group by key, ts
"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("event_type", (F.col("user_id") % 3).cast("string"))
    return table(spark, d, "events").select(key.alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))


@register("idempotent_hour", _ACCEPTED)
def idempotent_hour(spark: SparkSession, d: str) -> DataFrame:
    """The requests accepted, an hour or more after the last accepted one of their key."""
    found = first_accepted(_keyed(spark, d), WINDOW)
    return found.select("key", F.col("id").alias("event_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("stream_idempotent_hour", _ACCEPTED)
def stream_idempotent_hour(spark: SparkSession, d: str) -> DataFrame:
    """K3: the same from keyed state over four micro-batches."""
    found = Q.run_available(Q.accepted_of_key(Q.in_slices(_keyed(spark, d), "at", 4), WINDOW, "30 minutes"), "append")
    return found.select("key", F.col("id").alias("event_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))
