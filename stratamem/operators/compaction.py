"""Compaction: exact and semantic merging of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.text import content_hash
from stratamem.operators import vector
from stratamem.sources.delta import DeltaTables, kept_first
from stratamem.sources.scratch import written


def exact(records: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """(uuid, keeper, duplicate) of records with equal content hashes within ``keys``; the first in ``order`` is kept.

    Keepers are combined before the shuffle, so one content may be that of most records.
    """
    hashed = records.withColumn("hash", content_hash(F.col("content")))
    first = hashed.groupBy(*(F.col(k).alias(f"_{k}") for k in [*keys, "hash"])).agg(F.min(F.struct(*order, F.col("uuid").alias("_uuid")))["_uuid"].alias("keeper"))
    same = F.lit(True)
    for k in [*keys, "hash"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = hashed.join(first, same).drop(*(f"_{k}" for k in [*keys, "hash"]))
    return met.withColumn("duplicate", F.col("uuid") != F.col("keeper"))


def greedy_merge(memories: DataFrame, least: float) -> DataFrame:
    """(group, uuid, merged_into): the sequential pass over memories (group, uuid, vector, pos), with no limit on neighbours.

    In order of position each memory that is still there takes in all later ones of its group
    that are and whose similarity is ``least`` or more. That is the first independent set of
    the near ones in this order, found in rounds: what has nothing undecided near before it
    stays, and what is near to such a one goes. In the end each that goes is taken in by the
    first that stays. Equal vectors share their fate, so only the first of them is compared.
    Rounds are written tables over the pivot index; no pair is a row, and no group is a task.
    """
    rows = memories.where("group is not null and vector is not null").select("group", F.col("uuid").cast("long").alias("uuid"), F.col("pos").cast("long").alias("pos"), F.col("vector").cast("array<double>").alias("vector"))
    rows = written(rows, "memories")
    heads = written(rows.groupBy("group", "vector").agg(F.min(F.struct("pos", "uuid")).alias("_f")).select("group", "vector", F.col("_f.uuid").alias("id"), F.col("_f.pos").alias("pos")), "heads")
    index = vector.build(heads)
    if index is None:
        return rows.select("group", "uuid", F.col("uuid").alias("merged_into"))
    pivots, undecided, kept = index.pivots, index.cells, []
    while undecided.limit(1).count():
        blocked = written(vector.first_near(pivots, undecided, undecided, least), "blocked")
        staying = written(undecided.join(blocked, "id", "left_anti"), "staying")
        kept.append(staying)
        rest = undecided.join(blocked, "id", "left_semi")
        undecided = written(rest.join(vector.first_near(pivots, rest, staying, least), "id", "left_anti"), "undecided")
    keepers = kept[0]
    for some in kept[1:]:
        keepers = keepers.unionByName(some)
    gone = vector.first_near(pivots, index.cells.join(keepers.select("id"), "id", "left_anti"), keepers, least)
    fate = written(heads.select("group", "vector", "id").join(gone, "id", "left").select(F.col("group").alias("_g"), F.col("vector").alias("_v"), F.coalesce("host", "id").alias("merged_into")), "fates")
    met = rows.join(fate, (F.col("group") == F.col("_g")) & (F.col("vector") == F.col("_v")))
    return met.where("uuid <> merged_into").select("group", "uuid", "merged_into")


def daily_digest(memories: DataFrame, now: Column, hours: int = 24, least: float = 0.88) -> DataFrame:
    """(uuid, merged_into, step) of memories (group, uuid, content, vector, created_at, lifecycle_status, daily_run).

    Taken are the active ones of the last ``hours`` that no run has dealt with. First copies
    by content go to the earliest of their group (``exact``), then of those left the near
    ones, by vector (``semantic``); one without a vector has no near ones.
    """
    open_ = memories.where((F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours))) & (F.coalesce("lifecycle_status", F.lit("active")) == "active") & F.col("daily_run").isNull())
    judged = exact(open_, ["group"], ["created_at", "uuid"])
    left = judged.where("not duplicate and vector is not null")
    near = greedy_merge(left.select("group", "uuid", "vector", F.unix_micros(F.col("created_at").cast("timestamp")).alias("pos")), least)
    copies = judged.where("duplicate").select("uuid", F.col("keeper").alias("merged_into"), F.lit("exact").alias("step"))
    return copies.unionByName(near.select("uuid", "merged_into", F.lit("semantic").alias("step")))


def digest_store(spark: SparkSession, root: str) -> DeltaTables:
    """What runs of ``digest_batch`` leave below ``root``: a marker for each memory dealt with, the first memory of each content, the memories that took in others or may yet."""
    return DeltaTables(spark, root, {"markers": None, "contents": kept_first(["group", "hash"]), "keepers": None})


def digest_batch(store: DeltaTables, arriving: DataFrame, run: int, least: float = 0.88) -> None:
    """One run of the digest over memories (group, uuid, content, vector, created_at) that came since the run before.

    A run reads what arrives, and of earlier runs the first memory of each content and the
    keepers of the groups that something arrives in; what was merged away is never read
    again. Runs over windows in the order of time leave what one run over all would, and a
    run that is repeated replaces itself. Each memory gets a marker (uuid, merged_into, step).
    """
    pos = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = arriving.select("group", F.col("uuid").cast("long").alias("uuid"), pos.alias("pos"), F.col("vector").cast("array<double>").alias("vector"), content_hash(F.col("content")).alias("hash"))
    rows = written(rows, "arriving")
    known, keepers = store.read("contents", before=run), store.read("keepers", before=run)
    same = (F.col("group").eqNullSafe(F.col("_g"))) & F.col("hash").eqNullSafe(F.col("_h"))
    first = rows.groupBy(F.col("group").alias("_g"), F.col("hash").alias("_h")).agg(F.min(F.struct("pos", "uuid"))["uuid"].alias("_first"))
    if known is not None:
        before = known.select(F.col("group").alias("_kg"), F.col("hash").alias("_kh"), F.col("uuid").alias("_known"))
        first = first.join(before, F.col("_g").eqNullSafe(F.col("_kg")) & F.col("_h").eqNullSafe(F.col("_kh")), "left").select("_g", "_h", F.coalesce("_known", "_first").alias("_first"))
    judged = written(rows.join(first, same).drop("_g", "_h"), "judged")
    copies = judged.where("uuid <> _first").select("uuid", F.col("_first").alias("merged_into"), F.lit("exact").alias("step"))
    new = judged.where("uuid = _first and vector is not null and group is not null").select("group", "uuid", "pos", "vector")
    near = None
    if keepers is not None:
        old = written(keepers.join(new.select("group").distinct(), "group", "left_semi").select("group", F.col("uuid").alias("id"), "pos", "vector"), "touched")
        index = vector.build(old)
        if index is not None:
            # earlier keepers come before all that arrives, so each of these takes its share first
            guests = new.select("group", F.col("uuid").alias("id"), "pos", "vector", F.lit(0).alias("cell"))
            taken = written(vector.first_near(index.pivots, guests, index.cells, least), "taken")
            near = taken.select(F.col("id").alias("uuid"), F.col("host").alias("merged_into"))
            new = new.join(taken.select(F.col("id").alias("uuid")), "uuid", "left_anti")
    new = written(new, "fresh")
    among = written(greedy_merge(new, least), "among").select("uuid", "merged_into")
    near = among if near is None else near.unionByName(among)
    staying = new.join(among.select("uuid"), "uuid", "left_anti")
    merged = copies.unionByName(near.withColumn("step", F.lit("semantic")))
    marks = rows.select("uuid").join(merged, "uuid", "left")
    store.commit(run, {"markers": marks, "contents": judged.where("uuid = _first").select("group", "hash", "uuid"), "keepers": staying})


def digest_stats(memories_checked: DataFrame, merges: DataFrame) -> DataFrame:
    """(total_checked, merged_count, exact, semantic): one row about a run."""
    done = merges.agg(F.count(F.lit(1)).alias("merged_count"), F.count_if(F.col("step") == "exact").alias("exact"), F.count_if(F.col("step") == "semantic").alias("semantic"))
    return memories_checked.agg(F.count(F.lit(1)).alias("total_checked")).crossJoin(done)  # one row each


def nightly(citations: DataFrame, orphans: DataFrame, stale: DataFrame) -> DataFrame:
    """(phase, found): how many each audit of the night found, a row for each phase."""
    phases = (("citations", citations), ("orphans", orphans), ("stale_edges", stale))
    parts = [rows.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("phase"), "found") for name, rows in phases]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
