"""Closures over parent links: ancestors and descendants at any depth, without recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.sources.scratch import written


def rooted(links: DataFrame) -> DataFrame:
    """(id, root, depth) of each row of ``links`` (id, parent): the top of its tree and the steps up to it.

    Pointers double: each round a row that has not reached its root takes its pointer's
    pointer, so a tree of depth d takes log2(d) rounds, each one join. A parent that is no
    row counts as missing; rows on or below a cycle have a null root and depth. Rounds are
    written where all executors read them.
    """
    known = links.select(F.col("id").alias("_id"))
    met = links.join(known, F.col("parent") == F.col("_id"), "left").select("id", F.col("_id").alias("parent"))
    top = F.col("parent").isNull()
    state = written(met.select("id", F.coalesce("parent", "id").alias("root"), (~top).cast("long").alias("depth"), top.alias("done")), "tree")
    for _ in range(state.count().bit_length() + 1):
        open_ = state.where("not done")
        if not open_.limit(1).count():
            break
        above = state.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = open_.join(above, F.col("root") == F.col("_id")).select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = written(state.where("done").unionByName(moved), "tree")
    return state.select("id", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def descendants(links: DataFrame, tops: DataFrame) -> DataFrame:
    """The ids (id) at or below any of ``tops`` (id) in ``links`` (id, parent).

    Level by level from the tops; a level is a join of the links with the rows found last.
    """
    found = frontier = written(tops.select("id").join(links.select("id"), "id", "left_semi").distinct(), "below")
    while frontier.limit(1).count():
        below = links.join(frontier.select(F.col("id").alias("_p")), F.col("parent") == F.col("_p")).select("id").distinct()
        frontier = written(below.join(found, "id", "left_anti"), "below")
        found = found.unionByName(frontier)
    return found
