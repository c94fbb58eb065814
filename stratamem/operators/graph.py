"""Graph operators over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from ahocorasick import AHOCORASICK, TRIE, Automaton
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratamem.sources.scratch import written

#: Characters of the tokens of one automaton: so many states at most, a few dozen bytes each.
SHARD_CHARS = 1 << 20
#: Pages that one task runs through an automaton, about.
BLOCK_PAGES = 1 << 20


def in_degree(edges: DataFrame, to: str = "to_slug") -> DataFrame:
    """(slug, in_degree)."""
    return edges.groupBy(F.col(to).alias("slug")).agg(F.count(F.lit(1)).alias("in_degree"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages without an inbound edge."""
    return pages.join(edges.select(F.col("to_slug").alias("slug")), "slug", "left_anti")


_EDGE = ["from_slug", "edge_type", "to_slug"]


def edge_states(edges: DataFrame) -> DataFrame:
    """One row per edge that ``merged_states`` can fold further: confidence, first evidence that isn't empty with its time, first time."""
    told = F.when(F.col("evidence") != "", F.struct("created_at", "evidence"))
    return edges.groupBy(*_EDGE).agg(F.max("confidence").alias("confidence"), F.min(told).alias("told"), F.min("created_at").alias("created_at"))


def merged_states(states: DataFrame) -> DataFrame:
    """``edge_states`` of edges whose states are given."""
    return states.groupBy(*_EDGE).agg(F.max("confidence").alias("confidence"), F.min("told").alias("told"), F.min("created_at").alias("created_at"))


def told_edges(states: DataFrame) -> DataFrame:
    """The edges of ``edge_states``."""
    return states.select(*_EDGE, "confidence", F.col("told.evidence").alias("evidence"), "created_at")


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge per (from_slug, edge_type, to_slug): the highest confidence, the first evidence that isn't empty."""
    return told_edges(edge_states(edges))


def personalised_pagerank(
    vertices: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 30, alpha: float = 0.85, written_every: int = 5
) -> DataFrame:
    """(query_id, id, mass) after ``rounds`` of power iteration, all queries at once.

    The graph is undirected and simple; edges with an unknown end are dropped. ``seeds``
    (query_id, id) share the restart, and the mass of vertices without edges returns to
    them. Lineage is cut by tables in the shared folder every few rounds.
    """
    known = vertices.select("id").distinct()
    pairs = edges.select("src", "dst").where("src <> dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    seeds = seeds.join(known, "id", "left_semi").distinct()
    restart = seeds.withColumn("restart", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    restart = written(restart, "restart")
    # a seed without edges hands its mass to the seeds of its query, as if by edges of that query alone
    bare = restart.join(degree, F.col("id") == F.col("src"), "left_anti").select(F.col("query_id").alias("only"), F.col("id").alias("src"))
    back = bare.join(restart, F.col("only") == F.col("query_id")).select("only", "src", F.col("id").alias("dst"), F.col("restart").alias("share"))
    none = F.lit(None).cast(restart.schema["query_id"].dataType).alias("only")
    steps = written(both.join(degree, "src").select(none, "src", "dst", (1.0 / F.col("degree")).alias("share")).unionByName(back), "steps")
    mass = restart.select("query_id", "id", F.col("restart").alias("mass"))
    home = restart.select("query_id", "id", ((1 - alpha) * F.col("restart")).alias("mass"))
    for n in range(1, rounds + 1):
        along = (F.col("id") == F.col("src")) & (F.col("only").isNull() | (F.col("only") == F.col("query_id")))
        moved = mass.join(steps, along).select("query_id", F.col("dst").alias("id"), (alpha * F.col("mass") * F.col("share")).alias("mass"))
        mass = moved.unionByName(home).groupBy("query_id", "id").agg(F.sum("mass").alias("mass"))
        if n % written_every == 0 and n < rounds:
            mass = written(mass, "mass")
    return mass


def pages_with(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(token, page): each token met with the pages (page, slug) whose slug contains it; blank tokens meet none.

    Tokens are dealt into shards of ``SHARD_CHARS`` characters, pages into blocks of
    ``BLOCK_PAGES``. A task builds the Aho-Corasick automaton of a shard and runs each slug of
    a block through it once, however many tokens the shard has and however long they are.
    """
    asked = written(tokens.toDF("token").where("token <> ''").distinct(), "tokens")
    known = written(pages.select("page", "slug").where("slug <> ''").distinct(), "slugs")
    chars = asked.agg(F.sum(F.length("token")).alias("n")).first()["n"] or 0
    shards, blocks = max(1, -(-chars // SHARD_CHARS)), max(1, -(-known.count() // BLOCK_PAGES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), "token")
    right = known.select(every(shards).alias("shard"), F.pmod(F.xxhash64("page", "slug"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "page", "slug")
    place = ["shard", "block"]
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "kind")
    return dealt.mapInArrow(_inside, StructType([asked.schema["token"], known.schema["page"]])).distinct()


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, page) along rows in the order of ``pages_with``: a shard's tokens, then the pages that meet them."""
    at, machine = None, Automaton()
    for batch in batches:
        found: tuple[list, list] = ([], [])
        columns = (batch.column(c).to_pylist() for c in ("shard", "block", "kind", "token", "page", "slug"))
        for shard, block, kind, token, page, slug in zip(*columns):
            if (shard, block) != at:
                at, machine = (shard, block), Automaton()
            if kind == 0:
                machine.add_word(token, token)
                continue
            if machine.kind == TRIE:
                machine.make_automaton()
            if machine.kind == AHOCORASICK:
                for met in {met for _, met in machine.iter(slug)}:
                    found[0].append(met)
                    found[1].append(page)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], batch.schema.field("token").type), pa.array(found[1], batch.schema.field("page").type)], ["token", "page"])
