"""Registered queries: retrieval, ranking, scoring, evaluation, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.functions import score as S
from stratamem.operators import evaluation, keyword, rank, search, temporal, vector
from stratamem.plans.catalogue import register
from stratamem.plans.model import EVENTS_SQL, NOW, events, now, stamp
from stratamem.sources.scratch import written
from stratamem.sources.tables import table

#: Query vectors and texts: every row whose id is divisible by 50, against all rows.
QUERY_STEP = 50

_BOOSTS = " ".join(f"when '{k}' then {v}" for k, v in V.TYPE_BOOST.items())
_COSINE = "list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) / (sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(a.embedding, lambda x: x::double))) * sqrt(list_dot_product(list_transform(b.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))))"
_SIMILARITY = f"round(greatest(0.0, 1 - (1 - {_COSINE}) / 2), 9)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return found.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("query_id"), "vector"), found


VECTOR_SQL = f"""
select a.vec_id as query_id, b.vec_id as id, {_SIMILARITY} as similarity
from embeddings a cross join embeddings b where a.vec_id % {QUERY_STEP} = 0
"""


@register(
    "vector_topk",
    f"with s as ({VECTOR_SQL}) select query_id, id, round(similarity, 6) as similarity, row_number() over (partition by query_id order by similarity desc, id) as rank from s qualify rank <= 10",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most alike vectors of each query vector."""
    found = vector.nearest(*_vectors(spark, d), 10)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_RANKERS = """
users as (select user_id as id, count(*) as n, sum(value) as total, max(ts) as last from events group by user_id),
rankings as (
  select 1 as query_id, 'count' as channel, id, row_number() over (order by n desc, id) as rank from users
  union all select 1, 'sum', id, row_number() over (order by round(total, 6) desc, id) from users
  union all select 1, 'recent', id, row_number() over (order by last desc, id) from users
)"""


@register("rrf_fusion", f"with {_RANKERS} select id, round(sum(1.0 / ({V.RRF_K} + rank)), 9) as score, row_number() over (order by round(sum(1.0 / ({V.RRF_K} + rank)), 9) desc, id) as rank from rankings group by id")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Three rankings of users, fused."""
    users = written(table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("ts").alias("last")), "users")
    channels = [("count", "n"), ("sum", "total"), ("recent", "last")]
    found = None
    for name, column in channels:
        one = rank.along(users.select("id", column), "rank", F.desc(column), F.asc("id"))
        one = one.select(F.lit(1).alias("query_id"), F.lit(name).alias("channel"), "id", "rank")
        found = one if found is None else found.unionByName(one)
    fused = rank.fuse(found).select("id", F.round("score", 9).alias("score"))
    return rank.along(fused, "rank", F.desc("score"), F.asc("id"))


_SUPPLIERS = f"""
s as (select l_suppkey as id, sum(l_extendedprice) as revenue, count(distinct l_partkey) as parts from lineitem group by 1),
r as (select id, row_number() over (order by round(revenue, 2) desc, id) as a, row_number() over (order by parts desc, id) as b from s),
f as (select id, 1.0 / ({V.RRF_K} + a) + 1.0 / ({V.RRF_K} + b) as score from r),
x as (select f.id, f.score, s.s_name || ' of ' || n.n_name as truth, p.parts as degree from f join supplier s on s.s_suppkey = f.id join nation n on n.n_nationkey = s.s_nationkey join s p on p.id = f.id)
"""


@register(
    "rrf_boosted",
    f"with {_SUPPLIERS} select id, round(case when length(trim(truth)) >= {V.TRUTH_CHARS} then score * {V.TRUTH_FACTOR} else score end + case when degree > 0 then {V.BACKLINK_WEIGHT} * ln(1 + degree) else 0 end, 9) as score from x",
)
def rrf_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers ranked twice, fused, raised by their page and backlinks."""
    lines = written(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count_distinct("l_partkey").alias("parts")), "suppliers")
    both = None
    for name in ("revenue", "parts"):
        one = rank.along(lines.select("id", name), "rank", F.desc(name), F.asc("id")).select(F.lit(1).alias("query_id"), F.lit(name).alias("channel"), "id", "rank")
        both = one if both is None else both.unionByName(one)
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pages = named.select(F.col("s_suppkey").alias("id"), F.concat_ws(" of ", "s_name", "n_name").alias("truth"))
    found = rank.fuse(both).join(pages, "id", "left").join(lines.select("id", F.col("parts").alias("degree")), "id", "left")
    return found.select("id", F.round(S.boosted(F.col("score"), F.col("truth"), F.col("degree")), 9).alias("score"))


@register(
    "composite_score",
    f"""with e as ({EVENTS_SQL}), r as (
      select *, exp(-{V.DECAY} * greatest(floor(epoch({NOW} - created_at) / 86400), 0) / {V.HALF_LIFE_DAYS}) as decay, case memory_type {_BOOSTS} else {V.DEFAULT_BOOST} end as boost from e)
    select uuid, round(pow(greatest(({V.W_SIMILARITY} * similarity + {V.W_RECENCY} * decay + {V.W_IMPORTANCE} * importance * boost) * least(1 + 0.05 * access_count, 1.5), 0), 1.5), 6) as score from r""",
)
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """H1-H4: similarity, recency and importance of every episode in one score."""
    e = events(spark, d)
    fresh = S.recency(F.col("created_at"), now(), F.col("memory_type"))
    value = S.composite(F.col("similarity"), fresh, F.col("importance"), F.col("access_count"), F.col("memory_type"))
    return e.select("uuid", F.round(value, 6).alias("score"))


@register(
    "composite_search_topk",
    f"""with e as ({EVENTS_SQL}), r as (
      select *, exp(-{V.DECAY} * greatest(floor(epoch({NOW} - created_at) / 86400), 0) / {V.HALF_LIFE_DAYS}) as decay, case memory_type {_BOOSTS} else {V.DEFAULT_BOOST} end as boost from e where memory_type <> 'view'),
    s as (select group_id, uuid, round(pow(greatest(({V.W_SIMILARITY} * similarity + {V.W_RECENCY} * decay + {V.W_IMPORTANCE} * importance * boost) * least(1 + 0.05 * access_count, 1.5), 0), 1.5), 6) as score from r)
    select group_id, uuid, score, row_number() over (partition by group_id order by score desc, uuid) as rank from s qualify rank <= 10""",
)
def composite_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best episodes of each group by composite score, after a metadata filter."""
    e = events(spark, d).where("memory_type <> 'view'")
    fresh = S.recency(F.col("created_at"), now(), F.col("memory_type"))
    value = S.composite(F.col("similarity"), fresh, F.col("importance"), F.col("access_count"), F.col("memory_type"))
    scored = e.select("group_id", "uuid", F.round(value, 6).alias("score"))
    return rank.top_k(scored, ["group_id"], 10, F.desc("score"), F.asc("uuid")).withColumn("rank", F.col("rank").cast("long"))


_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}')"
OVERLAP_SQL = f"""
q as (select item_id as query_id, unnest(list_distinct({_TOKENS.format('text')})) as token, len(list_distinct({_TOKENS.format('text')})) as asked from benchmark),
t as (select doc_id as id, unnest(list_distinct({_TOKENS.format('text')})) as token from documents),
o as (select query_id, id, round(count(*) / max(asked), 9) as score from t join q using (token) group by 1, 2)
"""


def _benchmark(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@register("keyword_overlap", f"with {OVERLAP_SQL} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from o qualify rank <= 10")
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The documents that share most tokens with each benchmark text."""
    scored = keyword.overlap(*_benchmark(spark, d)).withColumn("score", F.round("score", 9))
    return rank.top_k(scored, ["query_id"], 10, F.desc("score"), F.asc("id")).withColumn("rank", F.col("rank").cast("long"))


BM25_SQL = f"""
bq as (select item_id as query_id, unnest(list_distinct({_TOKENS.format('text')})) as token from benchmark),
bt as (select doc_id as id, {_TOKENS.format('text')} as t from documents),
bc as (select count(*) as n, avg(len(t)) as mean from bt),
bp as (select id, token, count(*) as tf, any_value(size) as size from (select id, len(t) as size, unnest(t) as token from bt) group by 1, 2),
bd as (select token, count(*) as df from bp group by 1),
bm as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {keyword.K1 + 1} / (tf + {keyword.K1} * (1 - {keyword.B} + {keyword.B} * size / mean))), 6) as score
  from bp join bd using (token) join bq using (token) cross join bc group by 1, 2)
"""


@register("bm25_topk", f"with {BM25_SQL} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from bm qualify rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the whole collection."""
    scored = keyword.bm25(*_benchmark(spark, d)).withColumn("score", F.round("score", 6))
    return rank.top_k(scored, ["query_id"], 10, F.desc("score"), F.asc("id")).withColumn("rank", F.col("rank").cast("long"))


_HTML = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


def _channel_sql(name: str, rows: str, allowed: str, k: int) -> str:
    """BM25 of the questions (kq) over ``rows`` (id, text), the ``k`` best of those ``allowed``."""
    return f"""
{name}t as (select id, {_TOKENS.format('text')} as t from ({rows})),
{name}c as (select count(*) as n, avg(len(t)) as mean from {name}t),
{name}p as (select id, token, count(*) as tf, any_value(size) as size from (select id, len(t) as size, unnest(t) as token from {name}t) group by 1, 2),
{name}d as (select token, count(*) as df from {name}p group by 1),
{name}s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {keyword.K1 + 1} / (tf + {keyword.K1} * (1 - {keyword.B} + {keyword.B} * size / mean))), 6) as score
  from {name}p join {name}d using (token) join kq using (token) cross join {name}c group by 1, 2),
{name} as (select query_id, id, score from {name}s where {allowed} qualify row_number() over (partition by query_id order by score desc, id) <= {k})"""


#: What was judged to be of low quality is no longer active.
_RETIRED_SQL = "id not in (select doc_id from labels where quality = 0)"
_CHANNELS_SQL = f"""
kq as (select item_id as query_id, unnest(list_distinct({_TOKENS.format('text')})) as token from benchmark),
{_channel_sql('ke', 'select doc_id as id, text from documents', _RETIRED_SQL, 20)},
{_channel_sql('kp', f'select url as id, min({_HTML}) as text from pages group by 1', 'true', 20)},
kc as (select query_id, 'keyword:episode' as source, id::varchar as id, score from ke union all select query_id, 'keyword:page', id, score from kp)
"""


def _kept(spark: SparkSession, d: str) -> dict[str, tuple[keyword.Index, DataFrame | None]]:
    """Kept indexes of episodes, active ones allowed, and of pages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    retired = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    pages = table(spark, d, "pages").groupBy(F.col("url").alias("id")).agg(F.min(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))
    return {"keyword:episode": (keyword.build(docs), docs.select("id").join(retired, "id", "left_anti")), "keyword:page": (keyword.build(pages), None)}


@register("keyword_search", f"with {_CHANNELS_SQL} select query_id, source, id, score, row_number() over (partition by query_id order by score desc, id, source) as rank from kc qualify rank <= 20")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Active episodes and pages in one list, over kept indexes; a page's id is its address."""
    asked, _ = _benchmark(spark, d)
    return keyword.search_channels(asked, _kept(spark, d), 20).withColumn("rank", F.col("rank").cast("long"))


HYBRID_SQL = f"""
hv as ({VECTOR_SQL}),
hr as (
  select query_id / {QUERY_STEP} as query_id, 'vector' as channel, id, row_number() over (partition by query_id order by similarity desc, id) as rank from hv qualify rank <= 30
  union all select query_id, 'keyword', id, row_number() over (partition by query_id order by score desc, id) from bm qualify row_number() over (partition by query_id order by score desc, id) <= 20),
hf as (select query_id::bigint as query_id, id, sum(1.0 / ({V.RRF_K} + rank)) as score from hr group by 1, 2),
hd as (select doc_id as id, count(*) as degree from labels group by 1),
hb as (select query_id, hf.id, round(case when length(trim(text)) >= {V.TRUTH_CHARS} then score * {V.TRUTH_FACTOR} else score end + case when degree > 0 then {V.BACKLINK_WEIGHT} * ln(1 + degree) else 0 end, 9) as score, lang
  from hf left join documents on doc_id = hf.id left join hd on hd.id = hf.id)
"""


@register(
    "hybrid_search",
    f"with {BM25_SQL}, {HYBRID_SQL} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from hb where lang is not null qualify rank <= 10",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: vector and keyword channels, fused, boosted, filtered, the ten best per query.

    Query n is benchmark item n with vector 50 n. Labels stand for backlinks.
    """
    asked, vectors = _vectors(spark, d)
    near = vector.nearest(asked, vectors, 30).select((F.col("query_id") / QUERY_STEP).cast("long").alias("query_id"), F.lit("vector").alias("channel"), "id", "rank")
    words = rank.top_k(keyword.bm25(*_benchmark(spark, d)).withColumn("score", F.round("score", 6)), ["query_id"], 20, F.desc("score"), F.asc("id"))
    fused = rank.fuse(near.unionByName(words.select("query_id", F.lit("keyword").alias("channel"), "id", "rank")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    degree = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    met = fused.join(docs, "id", "left").join(degree, "id", "left").where("lang is not null")
    scored = met.select("query_id", "id", F.round(S.boosted(F.col("score"), F.col("text"), F.col("degree")), 9).alias("score"))
    return rank.top_k(scored, ["query_id"], 10, F.desc("score"), F.asc("id")).withColumn("rank", F.col("rank").cast("long"))


@register("composed_search")
def composed_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole read path, what was true then as believed later: intent, variants, three channels, boosts, filters, reordering.

    Query n is benchmark item n with vector 50 n, if there is one; its one variant has vector
    50 n + 1. Texts are documents, whose times and kinds are those of the event of the same number. Items
    are pages that their best documents point to, and a question starts at its own. Labels
    stand for backlinks, importance for a model's score.
    """
    texts, docs = _benchmark(spark, d)
    index = keyword.build(docs)
    numbered = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    place = (F.col("id") / QUERY_STEP).cast("long").alias("query_id")
    questions = texts.join(numbered.where(F.col("id") % QUERY_STEP == 0).select(place, "vector"), "query_id", "left")
    variants = texts.join(numbered.where(F.col("id") % QUERY_STEP == 1).select(place, "vector"), "query_id").select("query_id", F.lit(1).alias("variant"), F.concat(F.lit("about "), "text").alias("text"), "vector")
    item, doc = F.concat(F.lit("page "), "query_id"), F.concat(F.lit("doc "), "id")
    edges = written(keyword.search(texts, index, 10).hits.select(doc.alias("src"), item.alias("dst")), "mentions")
    vertices = docs.select(doc.alias("node"), "id").unionByName(texts.select(item.alias("node"), F.lit(None).cast("long").alias("id")))
    degree = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    pages = docs.select("id", F.col("text").alias("truth")).join(degree, "id", "left")
    true_at, known_at = (F.expr(f"timestamp_ntz '2024-01-0{day} 00:00:00'") for day in (3, 4))
    episodes = events(spark, d).withColumnRenamed("uuid", "id")
    kept = temporal.valid_at(true_at) & temporal.known_at(known_at)
    found = search.search(questions, variants, numbered, index, None, (vertices, edges, texts.select("query_id", item.alias("node"))), pages, episodes, 10, kept, F.col("importance"))
    return found.withColumn("rank", F.col("rank").cast("long"))


EVAL_KS = (1, 3, 5, 10)
_RANKED = f"v as ({VECTOR_SQL}), r as (select query_id, id, row_number() over (partition by query_id order by similarity desc, id) as rank from v where id <> query_id qualify rank <= 10)"
_REL = f"q as (select a.vec_id as query_id, b.vec_id as id from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % {QUERY_STEP} = 0)"
_EVAL = ", ".join(
    f"round(avg(h{k} / {k}.0), 4) as p_{k}, round(avg(h{k} / n), 4) as r_{k}, round(avg(g{k} / list_sum(list_transform(range(1, least({k}, n)::bigint + 1), lambda i: 1 / log2(i + 1)))), 4) as ndcg_{k}" for k in EVAL_KS
)
_HITS = ", ".join(f"coalesce(sum(case when rank <= {k} then 1 end), 0) as h{k}, coalesce(sum(case when rank <= {k} then 1 / log2(rank + 1) end), 0) as g{k}" for k in EVAL_KS)


@register(
    "eval_metrics",
    f"with {_RANKED}, {_REL}, s as (select q.query_id, count(*) as n, {_HITS}, min(rank) as first from q left join r on r.query_id = q.query_id and r.id = q.id group by 1) select {_EVAL}, round(avg(coalesce(1.0 / first, 0)), 4) as mrr from s",
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The quality of vector search, where vectors of one label are relevant to each other."""
    asked, vectors = _vectors(spark, d)
    found = vector.nearest(asked, vectors, 10, include_self=False)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluation.summary(evaluation.by_label(found, labels, asked.select("query_id"), EVAL_KS))


@register(
    "rerank_head_tail",
    f"""with {OVERLAP_SQL}, h as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from o qualify rank <= 40),
    x as (select h.*, length(text) as size from h join documents on doc_id = h.id)
    select query_id, id, rank, row_number() over (partition by query_id order by rank > 30, case when rank <= 30 then size end desc nulls last, rank) as new_rank from x""",
)
def rerank_head_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 hits reordered by another scorer, here the text's length; the tail as it was."""
    scored = keyword.overlap(*_benchmark(spark, d)).withColumn("score", F.round("score", 9))
    hits = rank.top_k(scored, ["query_id"], 40, F.desc("score"), F.asc("id"))
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("size"))
    out = rank.rerank_head(hits.join(sizes, "id"), 30, "size")
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


_AT = "timestamp '2024-01-15 00:00:00'"


@register("as_of_filter", f"with e as ({EVENTS_SQL}) select uuid from e where coalesce(valid_from, created_at) <= {_AT} and (valid_to is null or valid_to >= {_AT})")
def as_of_filter(spark: SparkSession, d: str) -> DataFrame:
    """C4: what was true at a time."""
    return events(spark, d).where(temporal.valid_at(F.expr(_AT.replace("timestamp", "timestamp_ntz")))).select("uuid")


@register("seen_as_of_filter", f"with e as ({EVENTS_SQL}) select uuid from e where coalesce(t_created, created_at) <= {_AT} and (t_expired is null or t_expired >= {_AT})")
def seen_as_of_filter(spark: SparkSession, d: str) -> DataFrame:
    """What was believed at a time."""
    return events(spark, d).where(temporal.known_at(F.expr(_AT.replace("timestamp", "timestamp_ntz")))).select("uuid")


@register(
    "bitemporal_both",
    f"with e as ({EVENTS_SQL}) select group_id, count(*) as n from e where coalesce(valid_from, created_at) <= {_AT} and (valid_to is null or valid_to >= {_AT}) and coalesce(t_created, created_at) <= timestamp '2024-01-20 00:00:00' and (t_expired is null or t_expired >= timestamp '2024-01-20 00:00:00') group by 1",
)
def bitemporal_both(spark: SparkSession, d: str) -> DataFrame:
    """C4 with C5: what was true then, as believed later."""
    then, later = F.expr(_AT.replace("timestamp", "timestamp_ntz")), F.expr("timestamp_ntz '2024-01-20 00:00:00'")
    return events(spark, d).where(temporal.valid_at(then) & temporal.known_at(later)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "as_of_many_anchors",
    f"with e as ({EVENTS_SQL}), a as (select unnest(range(timestamp '2024-01-01', timestamp '2024-02-01', interval 1 day)) as t0) select strftime(t0, '%Y-%m-%d') as day, count(*) as n, round(sum(importance), 6) as importance from a join e on created_at <= t0 and (valid_to is null or valid_to >= t0) group by 1",
)
def as_of_many_anchors(spark: SparkSession, d: str) -> DataFrame:
    """How much was true at each of many times, met over a tree of days."""
    e = events(spark, d).select("importance", F.col("created_at").alias("start"), F.col("valid_to").alias("end"))
    days = spark.range(31).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("at"))
    met = temporal.holding(e, days, 86400)
    return met.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("importance"), 6).alias("importance"))


@register(
    "fact_timeline",
    f"with e as ({EVENTS_SQL}) select group_id, uuid, memory_type, strftime(coalesce(valid_from, created_at), '%Y-%m-%d %H:%M:%S') as at, valid_to is null as is_current, row_number() over (partition by group_id, memory_type order by coalesce(valid_from, created_at), uuid) as position from e",
)
def fact_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each entity in order, with those that still hold."""
    when = F.coalesce("valid_from", "created_at")
    place = F.row_number().over(Window.partitionBy("group_id", "memory_type").orderBy(when, "uuid")).cast("long")
    return events(spark, d).select("group_id", "uuid", "memory_type", stamp(when).alias("at"), F.col("valid_to").isNull().alias("is_current"), place.alias("position"))
