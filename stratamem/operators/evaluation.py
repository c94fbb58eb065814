"""Retrieval quality: precision, recall, discounted gain and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(rankings: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), queries: DataFrame | None = None) -> DataFrame:
    """Per query of ``queries`` (query_id), or else of ``qrels`` (query_id, id): p_k, r_k, ndcg_k and rr of ``rankings`` (query_id, id, rank).

    A query that has nothing relevant, or was given no ranking, scores 0 throughout.
    """
    relevant = qrels.distinct()
    sizes = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    if queries is not None:
        sizes = queries.select("query_id").distinct().join(sizes, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    return scored(rankings.join(relevant, ["query_id", "id"], "left_semi").select("query_id", "rank"), sizes, ks)


def by_label(rankings: DataFrame, labels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``metrics`` of ``queries`` (query_id) where the other items of a query's label are relevant: ``labels`` (id, label).

    Labels of what was found are compared, and counts of labels say how many there are, so
    no pair of items is written out. A query without a label, or alone in it, scores 0.
    """
    counts = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = queries.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id", "left")
    sizes = own.join(counts, F.col("wanted") == F.col("label"), "left").select("query_id", (F.coalesce("n", F.lit(1)) - 1).alias("relevant"))
    found = rankings.join(labels, "id").join(own, "query_id").where("label = wanted and id <> query_id")
    return scored(found.select("query_id", "rank"), sizes, ks)


def scored(hits: DataFrame, sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``metrics`` from the ranks of relevant ``hits`` (query_id, rank) and how many are ``relevant`` (query_id, relevant)."""
    gain = 1 / F.log2(F.col("rank") + 1.0)
    aggs = [F.min("rank").alias("first")]
    for k in ks:
        within = F.col("rank") <= k
        aggs += [F.sum(F.when(within, 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when(within, gain).otherwise(0.0)).alias(f"g{k}")]
    out = sizes.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left")
    columns = {}
    for k in ks:
        h, g = F.coalesce(f"h{k}", F.lit(0)), F.coalesce(f"g{k}", F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant"))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        columns |= {f"p_{k}": h / float(k), f"r_{k}": h / F.greatest(F.lit(1), F.col("relevant")), f"ndcg_{k}": g / ideal}
    return out.select("query_id", *(c.alias(n) for n, c in columns.items()), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(per_query: DataFrame) -> DataFrame:
    """The means over all queries, rounded to 4 digits."""
    names = [c for c in per_query.columns if c not in ("query_id", "rr")]
    return per_query.agg(*(F.round(F.avg(c), 4).alias(c) for c in names), F.round(F.avg("rr"), 4).alias("mrr"))
