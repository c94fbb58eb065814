"""Registered queries: text classification, compaction, lifecycle, graph, sessions, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.functions import text as T
from stratamem.operators import compaction, extract, graph, jobs, lifecycle, rank, sessions, trees, vector
from stratamem.plans.catalogue import register
from stratamem.plans.model import EVENTS_SQL, NOW, events, now, stamp
from stratamem.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), F.col("text").alias("content"), F.col("lang").alias("group_id"), F.col("source").alias("agent_id"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HASH = f"substr(sha256(lower({_STRIP.format('text')})), 1, 16)"


def _any(text: str, words) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in quoted) + ")"


def _count(text: str, words) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in quoted) + ")"


@register("content_hash_dedup", f"with h as (select doc_id, {_HASH} as hash from documents) select doc_id as uuid, hash, min(doc_id) over (partition by hash) as keeper, doc_id <> min(doc_id) over (partition by hash) as duplicate from h")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Copies by normalised content; a window-free join of each hash with its least id."""
    hashed = _docs(spark, d).select("uuid", T.content_hash(F.col("content")).alias("hash"))
    keepers = hashed.groupBy("hash").agg(F.min("uuid").alias("keeper"))
    return hashed.join(keepers, "hash").select("uuid", "hash", "keeper", (F.col("uuid") != F.col("keeper")).alias("duplicate"))


@register(
    "session_compaction",
    f"with h as (select conv_id, turn, {_HASH} as hash from conversations) select conv_id, turn, first_value(turn) over (partition by conv_id, hash order by turn desc) as keeper, turn <> first_value(turn) over (partition by conv_id, hash order by turn desc) as duplicate from h",
)
def session_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Copies within a session; the newest stays."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("uuid"), F.col("text").alias("content"))
    return compaction.exact(rows, ["conv_id"], [-F.col("turn")]).select("conv_id", "turn", "keeper", "duplicate")


_DAY = f"created_at >= {NOW} - interval 30 day"


def _exact_sql(since: str) -> str:
    return f"""with e as ({EVENTS_SQL}), h as (select group_id, uuid, created_at, substr(sha256(lower(memory_type || ' ' || props)), 1, 16) as hash from e where {since})
    select group_id, uuid, first_value(uuid) over (partition by group_id, hash order by created_at, uuid) as keeper, uuid <> first_value(uuid) over (partition by group_id, hash order by created_at, uuid) as duplicate from h"""


def _exact_events(spark: SparkSession, d: str, since: str) -> DataFrame:
    rows = events(spark, d).where(F.col("created_at") >= now() - F.expr(since))
    rows = rows.withColumn("content", F.concat_ws(" ", "memory_type", "props"))
    return compaction.exact(rows, ["group_id"], ["created_at", "uuid"]).select("group_id", "uuid", "keeper", "duplicate")


@register("daily_digest_exact", _exact_sql(f"created_at >= {NOW} - interval 10 day"))
def daily_digest_exact(spark: SparkSession, d: str) -> DataFrame:
    """Copies within a group in a look-back window; the oldest stays."""
    return _exact_events(spark, d, "interval 10 day")


@register("weekly_merge", f"with x as ({_exact_sql(f'created_at >= {NOW} - interval 21 day')}) select group_id, keeper, count(*) as merged from x where duplicate group by 1, 2")
def weekly_merge(spark: SparkSession, d: str) -> DataFrame:
    """The merges of a week, by the memory that stays."""
    found = _exact_events(spark, d, "interval 21 day").where("duplicate")
    return found.groupBy("group_id", "keeper").agg(F.count(F.lit(1)).alias("merged"))


_PAIRS = """
select a.vec_id as query_id, b.vec_id as id, round(greatest(0.0, 1 - (1 - list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))) / 2), 9) as similarity
from embeddings a cross join embeddings b where a.vec_id <> b.vec_id
"""


#: The test vectors have no pair at the threshold of a digest, 0.88.
_NEAR = 0.7


@register("semantic_dup_pairs", f"with s as ({_PAIRS}), r as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s qualify rank <= 5) select query_id, id, round(similarity, 6) as similarity from r where similarity >= {_NEAR}")
def semantic_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A report of each memory's five nearest, where they are near."""
    found = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vector.nearest(found.withColumnRenamed("id", "query_id"), found, 5, _NEAR, include_self=False)
    return near.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@register("semantic_greedy_merge")
def semantic_greedy_merge(spark: SparkSession, d: str) -> DataFrame:
    """The sequential merge of near memories, all neighbours of the label."""
    memories = table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("group"), F.col("vec_id").cast("long").alias("uuid"), F.col("embedding").alias("vector"), F.col("vec_id").alias("pos")
    )
    return compaction.greedy_merge(memories.where("group is not null"), 0.6)


_STATES = "case o_orderstatus when 'F' then 'archived' when 'P' then 'outdated' else null end"
_WANTED = "case o_orderpriority when '1-URGENT' then 'deleted' when '2-HIGH' then 'superseded' when '3-MEDIUM' then 'active' when '4-NOT SPECIFIED' then 'archived' else 'confirmed' end"
_ALLOWED = " or ".join(f"(coalesce(s, 'active') = '{a}' and w in ({', '.join(repr(x) for x in b)}))" for a, b in V.TRANSITIONS.items() if b)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("uuid"),
        F.expr(_STATES).alias("lifecycle_status"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("t_expired"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.expr(_WANTED).alias("wanted"),
    )


@register("lifecycle_counts", f"select coalesce({_STATES}, 'active') as status, count(*) as n from orders group by 1")
def lifecycle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Memories by status."""
    return _records(spark, d).groupBy(lifecycle.status_or_active().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "lifecycle_transition",
    f"with r as (select o_orderkey as uuid, {_STATES} as s, {_WANTED} as w from orders), x as (select *, ({_ALLOWED}) as ok from r) select uuid, coalesce(s, 'active') as old_status, case when ok then w else coalesce(s, 'active') end as new_status, ok as accepted, case when ok and w in ('contradicted', 'superseded', 'deleted') then '2024-02-01 00:00:00' end as t_expired from x",
)
def lifecycle_transition(spark: SparkSession, d: str) -> DataFrame:
    """A transition asked of every record."""
    records = _records(spark, d)
    asked = records.select("uuid", lifecycle.status_or_active().alias("expected"), "wanted")
    out = lifecycle.transition(records.drop("wanted"), asked, now())
    return out.select("uuid", "old_status", "new_status", "accepted", stamp(F.col("t_expired")).alias("t_expired"))


@register("stale_candidates", f"select o_orderkey as uuid, floor(epoch({NOW} - o_orderdate) / 86400)::bigint as age_days from orders where coalesce({_STATES}, 'active') in ('active', 'confirmed') and o_orderdate < {NOW} - interval 30 day")
def stale_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Records left alone for a month, with their age."""
    return lifecycle.stale(_records(spark, d), now()).select("uuid", F.col("age_days").cast("long").alias("age_days"))


#: Rooms of the test tables' prose; rooms are a parameter, as a service has its own.
ROOMS = {
    "credentials": ("password", "secret", "token", "api_key", "key"),
    "licences": ("license", "copyright", "warranty", "rights reserved", "software"),
    "contacts": ("@", "phone", "email", "address", ".com"),
    "german": ("und", "der", "die", "nicht", "einheit", "verein"),
    "french": ("une", "les", "dans", "aux", "tion"),
    "english": ("the", "and", "with", "ing", "that"),
}


def _room_sql(text: str) -> str:
    scores = []
    for n, (_, words) in enumerate(ROOMS.items()):
        parts = [f"((length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}) * {2 if len(w) > 6 else 1}" for w in words]
        scores.append(f"({' + '.join(parts)}) as s{n}")
    best = ", ".join(f"s{n}" for n in range(len(ROOMS)))
    names = " ".join(f"when s{n} = top then '{name}'" for n, name in enumerate(ROOMS))
    return f"with s as (select doc_id, {', '.join(scores)} from (select doc_id, lower(text) as t from documents)), b as (select *, greatest({best}) as top from s) select doc_id as uuid, case when top < 2 then 'general' {names} end as room from b"


@register("room_detect", _room_sql("t"))
def room_detect(spark: SparkSession, d: str) -> DataFrame:
    """The topic of each text by keywords."""
    return _docs(spark, d).select("uuid", T.room(F.col("content"), ROOMS).alias("room"))


@register("room_counts", f"with r as ({_room_sql('t')}) select room, count(*) as n from r group by 1")
def room_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts by topic."""
    return room_detect(spark, d).groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@register("hall_map", "select event_type as memory_type, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.HALLS.items()) + " else 'context' end as hall, count(*) as n from events group by 1, 2")
def hall_map(spark: SparkSession, d: str) -> DataFrame:
    """Memory types in halls."""
    return events(spark, d).groupBy("memory_type", T.hall(F.col("memory_type")).alias("hall")).agg(F.count(F.lit(1)).alias("n"))


#: Texts in English made from rows, as the documents' prose is invented.
_NOTE = {
    "purchase": "[DECISION] Decided to use Plan {0}. It shipped on 2024-01-05 because the result was great",
    "signup": "User prefers short replies; always use metric units. This works at scale, see Handbook for {0}",
    "click": "We noticed the error and it is broken: we wonder what to do about it, question {0}",
    "view": "The team learned a lesson and fixed the outage. Group {0} met with Ada Vale at Harbor Labs",
}
_OTHER = "just now you said that you think it is this, as we said"


def _note_sql(kind: str, n: str) -> str:
    parts = []
    for k, v in _NOTE.items():
        a, b = v.split("{0}")
        parts.append(f"when '{k}' then concat('{a}', {n}, '{b}')")
    return f"case {kind} {' '.join(parts)} else '{_OTHER}' end"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("uuid"), F.expr(_note_sql("event_type", "cast(user_id as string)")).alias("content"), F.col("event_type").alias("episode_type"), F.concat(F.lit("group-"), "user_id").alias("group_id")
    )


_NOTES_SQL = f"select event_id as uuid, {_note_sql('event_type', 'user_id::varchar')} as content from events"
_TYPE_CASE = "case " + " ".join(f"when {_any('low', words)} then '{kind}'" for kind, words in V.TYPE_KEYWORDS.items()) + " else 'fact' end"
_HITS_CASE = "case kind " + " ".join(f"when '{kind}' then {_count('low', words)}" for kind, words in V.TYPE_KEYWORDS.items()) + " else 0 end"


@register(
    "classify_type",
    f"with n as ({_NOTES_SQL}), l as (select uuid, lower(content) as low from n), k as (select *, {_TYPE_CASE} as first from l), m as (select *, case when first in ('question', 'hypothesis') and {_any('low', V.RESOLUTION_KEYWORDS)} then 'outcome' else first end as kind from k) select uuid, kind as type, round(greatest(0.3, least(1.0, ({_HITS_CASE}) / 5.0 + 0.1)), 2) as confidence from m",
)
def classify_type(spark: SparkSession, d: str) -> DataFrame:
    """The memory type of each text, and how sure."""
    return _notes(spark, d).select("uuid", T.classify(F.col("content")).alias("c")).select("uuid", "c.type", "c.confidence")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register(
    "sentiment",
    f"with n as ({_NOTES_SQL}), w as (select uuid, list_distinct(string_split_regex(lower(content), '\\s+')) as w from n), c as (select uuid, len(list_intersect(w, {_list(V.POSITIVE_WORDS)})) as p, len(list_intersect(w, {_list(V.NEGATIVE_WORDS)})) as q from w) select uuid, case when p > q then 'positive' when q > p then 'negative' else 'neutral' end as sentiment from c",
)
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    """The sentiment of each text."""
    return _notes(spark, d).select("uuid", T.sentiment(F.lower("content")).alias("sentiment"))


@register("layer_detect")
def layer_detect(spark: SparkSession, d: str) -> DataFrame:
    """The layer each text belongs to."""
    return _notes(spark, d).select("uuid", T.detect_layer(F.col("content"), F.lit(None).cast("string")).alias("l")).select("uuid", "l.layer", "l.confidence")


@register("intent_classify")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    """The intent of each text as a query."""
    return _notes(spark, d).select("uuid", T.intent(F.col("content")).alias("intent"), T.expandable(F.col("content")).alias("expandable"))


_SLUG = "substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"


@register("slugify", f"with s as (select page_id as id, {_SLUG.format('url')} as slug from pages union all select p_partkey, {_SLUG.format('p_name')} from part) select id, slug, regexp_full_match(slug, '[a-z0-9][a-z0-9-]*') and length(slug) <= 80 as valid from s")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    """H8, C11: slugs of pages and parts."""
    names = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"))
    names = names.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    slugs = names.select("id", T.slugify(F.col("name")).alias("slug"))
    return slugs.withColumn("valid", T.is_slug(F.col("slug")))


@register("typed_edges")
def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """The typed edges of each text."""
    return extract.extract_edges(_notes(spark, d))


@register("entity_refs")
def entity_refs(spark: SparkSession, d: str) -> DataFrame:
    """The named entities of each text that tells of the world, with what they are."""
    return extract.entity_references(_notes(spark, d))


@register(
    "edge_upsert_max",
    "select 'supplier-' || l_suppkey as from_slug, l_returnflag as edge_type, 'part-' || l_partkey as to_slug, max(1 - l_discount) as confidence, min(l_orderkey) as first_seen from lineitem group by 1, 2, 3",
)
def edge_upsert_max(spark: SparkSession, d: str) -> DataFrame:
    """One edge per key at its highest confidence, seen first."""
    edges = table(spark, d, "lineitem").select(
        F.concat(F.lit("supplier-"), "l_suppkey").alias("from_slug"),
        F.col("l_returnflag").alias("edge_type"),
        F.concat(F.lit("part-"), "l_partkey").alias("to_slug"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_linestatus").alias("evidence"),
        F.col("l_orderkey").alias("created_at"),
    )
    return graph.upsert_edges(edges).select("from_slug", "edge_type", "to_slug", "confidence", F.col("created_at").alias("first_seen"))


@register(
    "evidence_timeline",
    "select role as slug, conv_id, min(turn) as first_turn, count(*) as n, min_by(substr(text, 1, 120), turn) as summary from conversations where trim(text) <> '' group by 1, 2",
)
def evidence_timeline(spark: SparkSession, d: str) -> DataFrame:
    """One evidence link per page and session, with its first time and summary."""
    rows = table(spark, d, "conversations").where(F.trim("text") != "")
    return rows.groupBy(F.col("role").alias("slug"), "conv_id").agg(
        F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"), F.min_by(F.left("text", F.lit(120)), "turn").alias("summary")
    )


@register(
    "orphans_by_domain",
    "with o as (select doc_id, lang from documents where doc_id not in (select doc_id from labels)) select lang as domain, count(*) as n, list_sort(list(doc_id))[1:5]::varchar as sample from o group by 1",
)
def orphans_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Pages that nothing points to, with five of each domain; the five are picked before they are collected."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("lang").alias("domain"))
    found = graph.orphans(pages, table(spark, d, "labels").select(F.col("doc_id").alias("to_slug")))
    counts = found.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    five = rank.top_k(found, ["domain"], 5, F.asc("slug")).groupBy("domain").agg(F.array_sort(F.collect_list("slug")).alias("s"))
    sample = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), F.lit("]"))
    return counts.join(five, "domain").select("domain", "n", sample.alias("sample"))


@register("stale_edges", f"select l.doc_id, d.lang is null as dangling from labels l left join documents d on d.doc_id = l.doc_id where d.doc_id is null or d.lang = 'es'")
def stale_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose target is gone, or is of a withdrawn group."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "lang")
    met = table(spark, d, "labels").join(docs, F.col("doc_id") == F.col("_id"), "left")
    return met.where("_id is null or lang = 'es'").select("doc_id", F.col("lang").isNull().alias("dangling"))


@register(
    "doctor_report",
    """with c as (select count(*) as total, count(*) filter (where text is null or trim(text) = '') as empty, count(*) filter (where doc_id not in (select doc_id from labels)) as orphan from documents)
    select 'embedding_fill' as check_name, round(1 - empty / total, 6) as ratio, case when 1 - empty / total >= 0.25 then 'PASS' else 'WARN' end as status from c
    union all select 'orphans', round(orphan / total, 6), case when orphan / total > 0.25 then 'FAIL' when orphan / total > 0.10 then 'WARN' else 'PASS' end from c""",
)
def doctor_report(spark: SparkSession, d: str) -> DataFrame:
    """Health checks with their verdicts."""
    docs = table(spark, d, "documents")
    marked = table(spark, d, "labels").select(F.col("doc_id").alias("_id")).distinct()
    met = docs.join(marked, F.col("doc_id") == F.col("_id"), "left")
    empty = F.col("text").isNull() | (F.trim("text") == "")
    c = met.agg(F.count(F.lit(1)).alias("total"), F.count_if(empty).alias("empty"), F.count_if(F.col("_id").isNull()).alias("orphan"))
    fill, lost = 1 - F.col("empty") / F.col("total"), F.col("orphan") / F.col("total")
    one = F.struct(F.lit("embedding_fill").alias("check_name"), F.round(fill, 6).alias("ratio"), F.when(fill >= 0.25, "PASS").otherwise("WARN").alias("status"))
    two = F.struct(F.lit("orphans").alias("check_name"), F.round(lost, 6).alias("ratio"), F.when(lost > 0.25, "FAIL").when(lost > 0.10, "WARN").otherwise("PASS").alias("status"))
    return c.select(F.inline(F.array(one, two)))


@register("in_degree", "select l_partkey as slug, count(*) as in_degree from lineitem group by 1")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    """Inbound edges of each page."""
    return graph.in_degree(table(spark, d, "lineitem"), "l_partkey")


_GRAPH = """
edges as (select distinct 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation union select 's' || s_suppkey, 'n' || s_nationkey from supplier union select 'c' || c_custkey, 'n' || c_nationkey from customer),
both_ as (select a, b from edges union select b, a from edges),
deg as (select a, count(*) as d from both_ group by 1),
seeds as (select 'c' || c_custkey as id, 1.0 / count(*) over () as w from customer where c_acctbal > 9900)
"""


def _pagerank_sql(rounds: int) -> str:
    parts, last = [], "m0 as (select id, w as m from seeds)"
    parts.append(last)
    for n in range(1, rounds + 1):
        parts.append(
            f"m{n} as (select coalesce(x.id, s.id) as id, 0.85 * coalesce(x.m, 0) + 0.15 * coalesce(s.w, 0) as m from (select b as id, sum(m / d) as m from m{n - 1} join both_ on a = id join deg using (a) group by 1) x full join seeds s on s.id = x.id)"
        )
    return f"with {_GRAPH}, {', '.join(parts)} select id, round(m, 9) as mass from m{rounds}"


@register("personalized_pagerank", _pagerank_sql(30))
def personalized_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Pages near a set of customers, by personalised PageRank."""
    nation, supplier, customer = (table(spark, d, n) for n in ("nation", "supplier", "customer"))

    def key(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    edges = nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))
    edges = edges.unionByName(supplier.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst")))
    edges = edges.unionByName(customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")))
    vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    seeds = customer.where("c_acctbal > 9900").select(F.lit(1).alias("query_id"), key("c", "c_custkey").alias("id"))
    return graph.personalised_pagerank(vertices, edges, seeds).select("id", F.round("mass", 9).alias("mass"))


_CHAIN = "links as (select o_orderkey as session, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent from orders)"


@register("session_chain", f"with recursive {_CHAIN}, c as (select session, session as ancestor, 0 as hops from links union all select c.session, l.parent, hops + 1 from c join links l on l.session = c.ancestor where l.parent is not null and hops < 3) select * from c")
def session_chain(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that each continues, three hops at most."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return sessions.chains(table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), before.alias("parent")))


_JOBS = "select o_orderkey as job_id, 6 - cast(substr(o_orderpriority, 1, 1) as int) as priority, case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'failed' end as status, o_orderdate as scheduled_at, o_orderdate as claimed_at, cast(o_totalprice as int) as timeout_seconds, 1 + o_custkey % 4 as attempts, 3 as max_attempts, o_custkey % 5 as queue from orders"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("scheduled_at"),
        F.col("o_orderdate").alias("claimed_at"),
        F.bround("o_totalprice").cast("int").alias("timeout_seconds"),
        (1 + F.col("o_custkey") % 4).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        (F.col("o_custkey") % 5).alias("queue"),
    )


#: Jobs as trees that branch: job n is below job n / 3, and jobs divisible by 50 are tops.
_TREE_SQL = "links as (select o_orderkey as id, case when o_orderkey % 50 <> 0 and o_orderkey // 3 in (select o_orderkey from orders) then o_orderkey // 3 end as parent from orders)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    above = F.when(F.col("job_id") % 50 != 0, F.floor(F.col("job_id") / 3))
    return jobs.withColumns({"parent_id": above, "failed_at": F.lit(None).cast("timestamp_ntz"), "failure_reason": F.lit(None).cast("string")})


@register("job_roots", f"with recursive {_TREE_SQL}, t as (select id, id as root, 0 as depth from links where parent is null union all select l.id, t.root, t.depth + 1 from t join links l on l.parent = t.id) select id as job_id, root, depth from t")
def job_roots(spark: SparkSession, d: str) -> DataFrame:
    """The top of each job's tree, and its depth, over trees of any shape."""
    return trees.rooted(_tree(spark, d).select(F.col("job_id").alias("id"), F.col("parent_id").alias("parent"))).withColumnRenamed("id", "job_id")


@register(
    "descendant_cancel",
    f"with recursive {_TREE_SQL}, jobs as ({_JOBS}), gone as (select id from links where id % 40 = 0 union select l.id from gone g join links l on l.parent = g.id) select job_id, case when gone.id is not null and status <> 'failed' then 'cancelled' else status end as status, case when gone.id is not null and status <> 'failed' then 'cancelled' end as failure_reason from jobs left join gone on gone.id = job_id",
)
def descendant_cancel(spark: SparkSession, d: str) -> DataFrame:
    """Some jobs cancelled with all below them, where not ended yet; trees branch."""
    all_jobs = _tree(spark, d)
    return jobs.cancel(all_jobs, all_jobs.where("job_id % 40 = 0"), now()).select("job_id", "status", "failure_reason")


@register("latest_per_group", f"with e as ({EVENTS_SQL}) select group_id, uuid, memory_type from e where created_at >= {NOW} - interval 72 hour qualify row_number() over (partition by group_id order by created_at desc, uuid desc) = 1")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The latest episode of each group in three days."""
    recent = events(spark, d).where(F.col("created_at") >= now() - F.expr("interval 72 hour"))
    return recent.groupBy("group_id").agg(F.max(F.struct("created_at", "uuid", "memory_type")).alias("x")).select("group_id", "x.uuid", "x.memory_type")


@register(
    "group_inventory",
    "with u as (select user_id::varchar as group_id, count(*) as n from events group by 1 union all select role, count(*) from conversations group by 1), s as (select role as group_id, count(distinct conv_id) as sessions from conversations group by 1) select u.group_id, sum(n)::bigint as episodes, coalesce(max(sessions), 0) as sessions from u left join s using (group_id) group by 1",
)
def group_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Episodes and sessions of each group."""
    a = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    talk = table(spark, d, "conversations").groupBy(F.col("role").alias("group_id"))
    counts = talk.agg(F.count_distinct("conv_id").alias("sessions"))
    both = a.unionByName(talk.agg(F.count(F.lit(1)).alias("n"))).groupBy("group_id").agg(F.sum("n").alias("episodes"))
    return both.join(counts, "group_id", "left").select("group_id", "episodes", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@register("session_detail", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as session_order, count(*) over (partition by conv_id) as episodes, length(text) // 4 as tokens from conversations")
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    """The episodes of each session in order."""
    rows = sessions.numbered(table(spark, d, "conversations"), "conv_id", F.asc("turn"))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn", "role", F.col("session_order").cast("long").alias("session_order"), n.alias("episodes"), F.floor(F.length("text") / 4).alias("tokens"))


@register("last_n_messages", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as position from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4)")
def last_n_messages(spark: SparkSession, d: str) -> DataFrame:
    """the last four messages of each session."""
    return sessions.last_n(table(spark, d, "conversations"), ["conv_id"], 4, "turn").select("conv_id", "turn", F.col("position").cast("long").alias("position"))


@register("last_by_role", "select conv_id, role, max(turn) as turn, max_by(substr(text, 1, 80), turn) as text from conversations where lower(trim(text)) <> 'heartbeat' group by 1, 2")
def last_by_role(spark: SparkSession, d: str) -> DataFrame:
    """The last message of each role that isn't a heartbeat."""
    rows = table(spark, d, "conversations").where(F.lower(F.trim("text")) != "heartbeat")
    return rows.groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.max_by(F.left("text", F.lit(80)), "turn").alias("text"))


_WOKEN = f"""with e as ({EVENTS_SQL}), i as (select group_id, memory_type as room, uuid as id, round(importance, 9) as score, '[' || memory_type || '] ' || substr(props, 1, 120) || case when length(props) > 120 then '...' else '' end as line from e where props <> '' qualify row_number() over (partition by group_id order by round(importance, 9) desc, uuid) <= 15),
    b as (select *, max(score) over (partition by group_id, room) as best from i),
    l as (select group_id, room, best, id, score, line, 1 as part from b union all select distinct group_id, room, best, null, null, chr(10) || '**' || room || ':**', 0 from b),
    s as (select *, 29 // 4 + sum(length(line) // 4) over (partition by group_id order by best desc, room, part, score desc, id rows unbounded preceding) as spent from l),
    w as (select * from s where part = 1 and spent <= 60)"""


def _woken(spark: SparkSession, d: str) -> DataFrame:
    items = events(spark, d).select("group_id", F.col("memory_type").alias("room"), F.col("memory_type").alias("type"), F.col("uuid").alias("id"), F.round("importance", 9).alias("score"), F.col("props").alias("text"))
    return sessions.wake_up(items, 60)


@register("wake_up_layer1", f"{_WOKEN} select group_id, room, id, score, spent::bigint as spent from w")
def wake_up_layer1(spark: SparkSession, d: str) -> DataFrame:
    """What fits a token budget as printed, best rooms first."""
    return _woken(spark, d).drop("line")


@register(
    "wake_up_texts",
    f"{_WOKEN}, r as (select group_id, room, min(spent) as first, string_agg('- ' || line, chr(10) order by spent, score, id) as block from w group by 1, 2) select group_id, '## Key Context (last 30 days)' || chr(10) || string_agg(chr(10) || '**' || room || ':**' || chr(10) || block, chr(10) order by first) as text from r group by 1",
)
def wake_up_texts(spark: SparkSession, d: str) -> DataFrame:
    """What each group wakes up with, as one text."""
    return sessions.wake_up_text(_woken(spark, d))


@register("queue_claim", f"with j as ({_JOBS}) select queue, job_id, priority, row_number() over (partition by queue order by priority desc, scheduled_at, job_id) as rank from j where status = 'pending' and scheduled_at <= timestamp '1998-01-01' qualify rank <= 20")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    """The next jobs of each queue."""
    found = jobs.claim(_jobs(spark, d), F.expr("timestamp_ntz '1998-01-01 00:00:00'"), 20, ["queue"])
    return found.select("queue", "job_id", "priority", F.col("rank").cast("long").alias("rank"))


@register("queue_stalled", f"with j as ({_JOBS}) select job_id from j where status = 'running' and claimed_at + to_seconds(2 * timeout_seconds) < timestamp '1996-06-01'")
def queue_stalled(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose lease ran out."""
    return jobs.stalled(_jobs(spark, d), F.expr("timestamp_ntz '1996-06-01 00:00:00'")).select("job_id")


@register("queue_retry", f"with j as ({_JOBS}) select job_id, case when attempts < max_attempts then 'pending' else 'dead' end as next_status, case when attempts < max_attempts then least(3600, 5 * pow(2, attempts - 1))::bigint end as wait_seconds from j where status = 'failed'")
def queue_retry(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of failed jobs."""
    return jobs.retry(_jobs(spark, d).where("status = 'failed'"), now()).select("job_id", "next_status", "wait_seconds")


_OUT = "case o_orderkey % 3 when 0 then 'complete' when 1 then 'fail' else 'none' end"
_CLAIMED = f"with j as (select *, {_OUT} as ends from ({_JOBS}) join orders on o_orderkey = job_id)"


def _claimed(spark: SparkSession, d: str) -> DataFrame:
    """The test jobs, those at work as claimed, with the columns that the queue keeps."""
    none = {"worker_id": "string", "completed_at": "timestamp_ntz", "result": "string"}
    rows = _tree(spark, d).withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    return rows.withColumn("status", F.when(F.col("status") == "running", "claimed").otherwise(F.col("status"))).withColumn("worker_id", F.concat(F.lit("w"), (F.col("job_id") % 2).cast("string")))


@register("queue_complete", f"{_CLAIMED} select job_id as child_id, job_id // 3 as parent_id, 'r' || job_id as result from j where status = 'running' and ends = 'complete' and job_id % 50 <> 0")
def queue_complete(spark: SparkSession, d: str) -> DataFrame:
    """What the completion of claimed jobs leaves in their parents' inbox."""
    rows = _claimed(spark, d)
    results = rows.where("job_id % 3 = 0").select("job_id", F.concat(F.lit("r"), F.col("job_id").cast("string")).alias("result"))
    _, inbox = jobs.complete(rows, results, now())
    taken, left = jobs.collected(inbox, rows.select(F.col("parent_id")).where("parent_id is not null").distinct())
    return taken.unionByName(left).select("child_id", "parent_id", "result")


@register(
    "queue_fail",
    f"{_CLAIMED}, f as (select *, status = 'running' and ends = 'fail' as mine, job_id % 2 = 0 as again from j) select job_id, case when not mine then case status when 'running' then 'claimed' else status end when again and attempts < max_attempts then 'pending' when again then 'dead' else 'failed' end as status, case when mine then 'broke' end as failure_reason, strftime(case when mine and again and attempts < max_attempts then {NOW} + to_seconds(least(3600, 5 * pow(2, attempts - 1))::bigint) else scheduled_at end, '%Y-%m-%d %H:%M:%S') as scheduled_at from f",
)
def queue_fail(spark: SparkSession, d: str) -> DataFrame:
    """What failures make of claimed jobs."""
    rows = _claimed(spark, d)
    failures = rows.where("job_id % 3 = 1").select("job_id", F.lit("broke").alias("reason"), (F.col("job_id") % 2 == 0).alias("retriable"))
    return jobs.fail(rows, failures, now()).select("job_id", "status", "failure_reason", stamp(F.col("scheduled_at")).alias("scheduled_at"))


@register("queue_renew", f"with j as ({_JOBS}) select job_id from j where status = 'running' and job_id % 2 = 1 and job_id % 5 = 0")
def queue_renew(spark: SparkSession, d: str) -> DataFrame:
    """The leases that workers renew, where they still hold them."""
    rows = _claimed(spark, d)
    asked = rows.where("job_id % 5 = 0").select("job_id", F.lit("w1").alias("worker_id"))
    return jobs.renew(rows, asked, now()).where(F.col("claimed_at") == now()).select("job_id")


_SUBMIT = """with known as (select l_orderkey as id, l_orderkey % 10 as depth, 'job-' || l_orderkey % 7 as name, case when l_orderkey % 4 = 0 then 'k' || l_orderkey % 100 end as key from (select distinct l_orderkey from lineitem where l_orderkey % 3 = 0)),
  r as (select o_orderkey as id, 'job-' || o_orderkey % 7 as name, case when o_orderkey % 2 = 0 then 'k' || o_orderkey % 100 end as key, case when o_orderkey % 5 = 0 then o_orderkey // 2 end as parent, o_orderkey % 11 as timeout, o_orderkey % 13 as tries from orders),
  e as (select name, key, min(id) as existing from known where key is not null group by 1, 2),
  m as (select r.*, case when r.parent is null then 0 else p.depth + 1 end as depth, e.existing, case when timeout <= 0 then 'timeout_seconds' when tries < 1 then 'max_attempts' when r.parent is not null and p.id is null then 'parent_id' when r.parent is not null and p.depth + 1 > 8 then 'depth' end as reason from r left join known p on p.id = r.parent left join e on e.name = r.name and e.key = r.key),
  f as (select *, case when key is not null and reason is null then coalesce(existing, min(id) over (partition by name, key, reason is null)) else id end as first from m)
  select id as request_id, case when reason is null then first end as job_id, reason, reason is null and first = id and existing is null as created, case when reason is null then depth end as depth from f"""


@register("queue_submit", _SUBMIT)
def queue_submit(spark: SparkSession, d: str) -> DataFrame:
    """Jobs submitted under a parent and a key, with what is refused and why."""
    ids = table(spark, d, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("job_id")).distinct()
    name = F.concat(F.lit("job-"), (F.col("job_id") % 7).cast("string"))
    key = F.concat(F.lit("k"), (F.col("job_id") % 100).cast("string"))
    known = ids.select("job_id", name.alias("name"), (F.col("job_id") % 10).alias("depth"), F.lit(None).cast("bigint").alias("parent_id"), F.when(F.col("job_id") % 4 == 0, key).alias("idempotency_key"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    asked = asked.select(
        "job_id",
        name.alias("name"),
        F.when(F.col("job_id") % 2 == 0, key).alias("idempotency_key"),
        F.when(F.col("job_id") % 5 == 0, F.floor(F.col("job_id") / 2)).alias("parent_id"),
        (F.col("job_id") % 11).alias("timeout_seconds"),
        (F.col("job_id") % 13).alias("max_attempts"),
        F.lit(None).cast("timestamp_ntz").alias("scheduled_at"),
    )
    return jobs.submit(known, asked, now()).select("request_id", "job_id", "reason", "created", "depth")


@register("idempotent_dedupe", "select user_id, event_type, date_diff('hour', timestamp '2024-01-01', ts) as hour, min(event_id) as first_id, count(*) as n from events group by 1, 2, 3")
def idempotent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One job per key and hour."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz '2024-01-01 00:00:00', ts)")
    return table(spark, d, "events").groupBy("user_id", "event_type", hour.alias("hour")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


_WORDS_SQL = "select distinct unnest(string_split(lower(p_type), ' ')) as token from part union select distinct lower(split_part(p_name, ' ', 1)) from part"


@register("entity_page_match", f"with t as ({_WORDS_SQL}), p as (select p_partkey as page, {_SLUG.format('p_name')} as slug from part) select distinct token, page from t join p on contains(slug, token) where token <> ''")
def entity_page_match(spark: SparkSession, d: str) -> DataFrame:
    """Entity tokens met with the pages whose slug has them, also inside a word."""
    parts = table(spark, d, "part")
    words = parts.select(F.explode(F.split(F.lower("p_type"), " ")).alias("token")).union(parts.select(F.split(F.lower("p_name"), " ")[0]))
    return graph.pages_with(words, parts.select(F.col("p_partkey").alias("page"), T.slugify(F.col("p_name")).alias("slug")))


_CITED = "concat(case event_type when 'click' then 'see [cite: ] now' when 'view' then 'see episode abc and on' when 'signup' then 'text [cite: open' else 'plain ' end, ' ', user_id{0})"
_CITATIONS = ", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end" for k, p in V.CITATION_PATTERNS.items())


@register("citation_audit", f"with c as (select event_id as uuid, {_CITED.format('::varchar')} as t from events) select uuid, array_to_string(list_filter([{_CITATIONS}], lambda x: x is not null), ',') as broken from c")
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Broken citations in each text."""
    texts = table(spark, d, "events").select(F.col("event_id").alias("uuid"), F.expr(_CITED.format("")).alias("t"))
    return texts.select("uuid", F.array_join(T.broken_citations(F.col("t")), ",").alias("broken"))


@register("significance_filter", f"select doc_id as uuid from documents where length({_STRIP.format('text')}) >= {V.SIGNIFICANT_CHARS} and {_any('lower(text)', V.SIGNIFICANT_KEYWORDS)}")
def significance_filter(spark: SparkSession, d: str) -> DataFrame:
    """The texts worth keeping."""
    return _docs(spark, d).where(T.is_significant(F.col("content"))).select("uuid")


_ABUSE = " ".join(f"when regexp_matches(text, '{p}') then 'shell_payload_pattern:{p}'" for p in V.SHELL_PATTERNS)


@register("abuse_audit", f"select doc_id as uuid, case when strlen(text) > {V.MAX_CONTENT_BYTES} then 'content_over_10kb' {_ABUSE} end as reason, case when trim(source) = '' then 'empty_or_non_string' when not regexp_matches(source, '{V.GROUP_ID_PATTERN}') then 'non_canonical_shape' end as group_reason from documents")
def abuse_audit(spark: SparkSession, d: str) -> DataFrame:
    """Suspect texts and group ids, with the reason."""
    return _docs(spark, d).select("uuid", T.abuse_reason(F.col("content")).alias("reason"), T.group_id_reason(F.col("agent_id")).alias("group_reason"))


_CODE = " or ".join("regexp_matches(x, '^(?:" + p.replace("'", "''") + ")')" for p in V.CODE_PATTERNS)


@register(
    "code_line_filter",
    f"with l as (select page_id, unnest(string_split(html, chr(10))) as x, generate_subscripts(string_split(html, chr(10)), 1) as n from pages), s as (select *, {_STRIP.format('x')} as b from l), k as (select * from s where b <> '' and not (length(b) > 5 and length(regexp_replace(b, '\\P{{L}}', '', 'g')) / greatest(length(b), 1) < 0.4) and not ({_CODE})) select p.page_id, count(k.x) as lines, coalesce(sum(length(k.x)), 0)::bigint as chars from pages p left join k using (page_id) group by 1",
)
def code_line_filter(spark: SparkSession, d: str) -> DataFrame:
    """The lines of prose of each page."""
    kept = table(spark, d, "pages").select("page_id", T.prose(F.col("html")).alias("p"))
    lines = F.filter(F.split("p", "\n", -1), lambda x: x != "")
    return kept.select("page_id", F.size(lines).cast("long").alias("lines"), F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@register("union_distinct_labels", "select distinct lang as label from documents union select role from conversations union select event_type from events")
def union_distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of all kinds of nodes, each once."""
    parts = [table(spark, d, t).select(F.col(c).alias("label")) for t, c in (("documents", "lang"), ("conversations", "role"), ("events", "event_type"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@register("json_metadata_filter", "select event_id as uuid, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as bigint) >= 50")
def json_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter on a key of the metadata."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select(F.col("event_id").alias("uuid"), k.alias("k")).where("k >= 50")


@register(
    "snapshot_format",
    "select conv_id, '# Session ' || conv_id || chr(10) || string_agg('- ' || role || ': ' || case when length(text) > 60 then substr(text, 1, 60) || '...' else text end, chr(10) order by turn) as body from conversations group by 1",
)
def snapshot_format(spark: SparkSession, d: str) -> DataFrame:
    """Each session as a short outline."""
    short = F.when(F.length("text") > 60, F.concat(F.left("text", F.lit(60)), F.lit("..."))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("- "), "role", F.lit(": "), short).alias("line")).alias("x"))
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit("# Session "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.col("x.line"), "\n"))
    return lines.select("conv_id", body.alias("body"))
