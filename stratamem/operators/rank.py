"""Ranking: positions, reciprocal rank fusion, top-k and head reranking. Every order ends in the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.sources.scratch import written


def ranked(scores: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``scores`` with ``rank`` from 1 within ``keys``."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(scores: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows within ``keys``, with their rank; Spark limits each group before the shuffle."""
    return ranked(scores, keys, *order).where(F.col("rank") <= k)


#: Rows of a range that ``along`` sorts in one task, about.
RANGE_ROWS = 1 << 16


def along(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place from 1 in the order of all rows as ``name``, however many there are.

    Rows are sorted in ranges, and a range's rows are numbered on from how many the ranges
    before it have: only those counts, one for each range, meet in one place.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    sorted_ = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    range_, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.join(before, range_ == F.col("_range")).withColumn(name, F.col("_before") + place + 1).drop("_m", "_range", "_before")


def dedupe_rankings(rankings: DataFrame) -> DataFrame:
    """(query_id, channel, id, rank) of (query_id, channel, pos, id): each id once, ranked anew; empty ids are skipped."""
    first = rankings.where("id is not null and cast(id as string) <> ''").groupBy("query_id", "channel", "id").agg(F.min("pos").alias("pos"))
    return ranked(first, ["query_id", "channel"], F.asc("pos"), F.asc("id")).drop("pos")


def fuse(rankings: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion of (query_id, channel, id, rank)."""
    if k <= 0:
        raise ValueError("k must be positive")
    return rankings.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def rerank_head(hits: DataFrame, cap: int, score: str) -> DataFrame:
    """``hits`` (query_id, rank, ...) with ``new_rank``: the first ``cap`` by ``score``, the tail as it was."""
    head = F.col("rank") <= cap
    order = Window.partitionBy("query_id").orderBy(~head, F.when(head, F.col(score)).desc_nulls_last(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(order))
