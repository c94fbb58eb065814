"""Composed search: what a question's intent asks for, fused, raised, filtered and reordered, all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions import score as S
from stratamem.functions import text as T
from stratamem.operators import graph, keyword, rank, vector

#: Variants of a question, at most.
VARIANTS = 3
#: Hits that a model reorders, at most.
RERANKED = 30


@dataclass(frozen=True)
class Depths:
    """How many hits each channel brings for so many wanted."""

    vector: int
    keyword: int
    graph: int

    @classmethod
    def of(cls, limit: int) -> Depths:
        if limit < 1:
            raise ValueError("limit must be positive")
        return cls(max(3 * limit, 20), max(2 * limit, 10), max(5 * limit, 30))


def planned(questions: DataFrame) -> DataFrame:
    """``questions`` (query_id, text, ...) with what they ask for: ``intent``, ``expands`` and ``walks``; blank ones are left out.

    Long enough questions about an entity or nothing in particular are searched by their
    variants too; questions that link entities walk the graph.
    """
    asked = questions.where(T.strip(F.col("text")) != "").withColumn("intent", T.intent(F.col("text")))
    return asked.withColumns({"expands": F.col("intent").isin("entity", "general") & T.expandable(F.col("text")), "walks": F.col("intent") == "multi_hop"})


def by_vector(asked: DataFrame, variants: DataFrame, index: vector.Index | None, depth: int) -> DataFrame:
    """(query_id, channel, id, rank) of questions (query_id, text, vector, expands) and of those ``variants`` (query_id, variant, text, vector) that count.

    Variants are numbered from 1 to ``VARIANTS``; one that repeats the question or a variant
    before it, but for case and outer spaces, does not count. Each is a channel of its own.
    """
    bare = F.lower(T.strip(F.col("text")))
    own = asked.select("query_id", F.lit(0).alias("variant"), bare.alias("bare"), "vector")
    more = variants.where(F.col("variant").between(1, VARIANTS)).join(asked.where("expands").select("query_id"), "query_id", "left_semi")
    more = more.select("query_id", F.col("variant").cast("int").alias("variant"), bare.alias("bare"), "vector").where("bare <> ''")
    first = own.unionByName(more).groupBy("query_id", "bare").agg(F.min(F.struct("variant", "vector")).alias("v")).select("query_id", "v.variant", "v.vector")
    keyed = first.select((F.col("query_id") * (VARIANTS + 1) + F.col("variant")).alias("query_id"), "vector")
    near = vector.nearest(keyed, None, depth, index=index) if index else None
    if near is None:
        return rankings_of(asked.sparkSession)
    variant = F.pmod("query_id", F.lit(VARIANTS + 1))
    return near.select(F.floor((F.col("query_id") - variant) / (VARIANTS + 1)).alias("query_id"), F.concat(F.lit("vector "), variant).alias("channel"), "id", "rank")


def by_graph(asked: DataFrame, vertices: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, rounds: int) -> DataFrame:
    """(query_id, channel, id, rank): what is near the ``seeds`` (query_id, node) of the questions that walk.

    ``vertices`` are (node, id); those without an id, such as pages, are passed through and are no hits.
    """
    started = seeds.join(asked.where("walks").select("query_id"), "query_id", "left_semi").select("query_id", F.col("node").alias("id"))
    if started.isEmpty():
        return rankings_of(asked.sparkSession)
    mass = graph.personalised_pagerank(vertices.select(F.col("node").alias("id")), edges, started, rounds).withColumnRenamed("id", "node")
    met = mass.where("mass > 0").join(vertices.where("id is not null"), "node").withColumn("mass", F.round("mass", 12))
    return rank.top_k(met, ["query_id"], depth, F.desc("mass"), F.asc("id")).select("query_id", F.lit("graph").alias("channel"), "id", "rank")


def rankings_of(spark) -> DataFrame:
    """No rankings."""
    return spark.createDataFrame([], "query_id long, channel string, id long, rank int")


def compose(rankings: DataFrame, pages: DataFrame, episodes: DataFrame, limit: int, kept: Column | None = None, model: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``limit`` best hits of each question.

    ``rankings`` (query_id, channel, id, rank) are fused; ``pages`` (id, truth, in_degree)
    raise the scores; only ``episodes`` (id, ...) for which ``kept`` holds stay, after fusing,
    so that they keep their scores. With ``model`` the first ``RERANKED`` that stay are put in
    its order, nulls last; scores stay as they are. Ties go to the lesser id.
    """
    met = rank.fuse(rankings).join(pages, "id", "left")
    raised = met.select("query_id", "id", F.round(S.boosted(F.col("score"), F.col("truth"), F.col("in_degree")), 9).alias("score"))
    stayed = raised.join(episodes.where(kept) if kept is not None else episodes, "id")
    hits = rank.top_k(stayed, ["query_id"], max(limit, RERANKED), F.desc("score"), F.asc("id"))
    if model is not None:
        hits = rank.rerank_head(hits.withColumn("_model", model), RERANKED, "_model").drop("rank").withColumnRenamed("new_rank", "rank")
    return hits.where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")


def search(
    questions: DataFrame,
    variants: DataFrame,
    vectors: DataFrame,
    words: keyword.Index,
    allowed: DataFrame | None,
    walk: tuple[DataFrame, DataFrame, DataFrame],
    pages: DataFrame,
    episodes: DataFrame,
    limit: int,
    kept: Column | None = None,
    model: Column | None = None,
    rounds: int = 30,
) -> DataFrame:
    """(query_id, id, score, rank) of ``questions`` (query_id, text, vector) with long ids: the whole read path.

    Vectors, variants and the ``model``'s score are inputs, as models are. ``walk`` has the
    vertices, edges and seeds of ``by_graph``; the rest is as in ``by_vector``,
    ``keyword.search`` and ``compose``.
    """
    asked, depths = planned(questions), Depths.of(limit)
    near = by_vector(asked, variants, vector.build(vectors), depths.vector)
    told = keyword.search(asked.select("query_id", "text"), words, depths.keyword, allowed).hits.select("query_id", F.lit("keyword").alias("channel"), "id", "rank")
    walked = by_graph(asked, *walk, depths.graph, rounds)
    return compose(near.unionByName(told).unionByName(walked), pages, episodes, limit, kept, model)
