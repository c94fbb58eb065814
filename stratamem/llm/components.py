"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of ``links`` (a, b); a component is named by its least node.

    Each round names a node after the least one around it, follows the names to their ends
    in doubling steps, and rewrites the links to the names of their ends; those whose ends
    agree leave for good. So the links, and the nodes of a round, shrink from round to round.
    Rounds are written tables; a hot node's rows are combined before the shuffle. Self links
    make a node known; null ends are dropped.
    """
    pairs = links.where("a is not null and b is not null")
    links, rounds = materialise(_ordered(pairs, F.col("a"), F.col("b")), "links"), []
    while not rounds or links.limit(1).count():
        names = _followed(_least_around(links))
        left, right = (names.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_in_{x}")) for x in "ab")
        named = links.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).where("_in_a <> _in_b")
        links = materialise(_ordered(named, F.col("_in_a"), F.col("_in_b")), "links")
        rounds.append(names)
    found = rounds[0]
    for names in rounds[1:]:
        step = names.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        found = found.join(step, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    return found if len(rounds) == 1 else materialise(found, "names")


def _followed(names: DataFrame) -> DataFrame:
    """(node, component) with each name followed to the node that is named after itself."""
    while True:
        names = materialise(names, "names")
        far = names.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        further = names.join(far, (F.col("component") == F.col("_n")) & (F.col("component") != F.col("_c")), "left")
        if not further.where("_c is not null").limit(1).count():
            return names
        names = further.select("node", F.coalesce("_c", "component").alias("component"))


def _ordered(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Each pair once, the greater end first."""
    return pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _least_around(links: DataFrame) -> DataFrame:
    """(node, component): the least of each node and those linked to it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
