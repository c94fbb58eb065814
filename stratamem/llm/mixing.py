"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import fresh, materialise, unit_hash, with_before

#: Documents that one fold pairs; also the arity of the reduction tree.
BLOCK = 128
#: Copies of a document stop here, and so does a source's target over its size.
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)

#: own: the size of one row; size: that of all rows with this id, source and size.
ITEM = "struct<id:bigint,own:bigint,size:bigint,p:double>"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """Per source of ``items`` (source, size): ``source_size`` and ``target``.

    Sources in code-point order, null last, get ``weights`` in turn. The targets share the
    total size by weight, each at most ``cap`` times its source's size; what is above is
    shared among the rest by weight until nothing is above. That fixed point is
    min(cap * size, level * weight) with one common level. With the sources sorted by the
    level at which they fill up, it is the largest of the levels that follow from calling
    the first so many full. Sources are sorted in ranges, so there may be very many.
    """
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    keys = {"_null": F.col("source").isNull().cast("int"), "_key": F.coalesce("source", F.lit("")), "_one": F.lit(1).cast("long")}
    placed = with_before(sizes.withColumns(keys), ["_null", "_key"], {"place": "_one"}, "mix-places")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("full", (F.col("source_size") * cap).cast("double"))
    placed = materialise(placed.withColumn("fills_at", F.col("full") / F.col("weight")), "mix-weights")
    total, weighed = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    filled = with_before(placed, ["fills_at", "_null", "_key"], {"full_before": "full", "weight_before": "weight"}, "mix-filled")
    level = filled.agg(F.max((F.lit(total) - F.col("full_before")) / (F.lit(weighed) - F.col("weight_before")))).first()[0]
    return placed.select("source", "source_size", F.least("full", F.lit(level).cast("double") * F.col("weight")).alias("target"))


def _pair(state: Column, x: Column, seed: int, level: int) -> Column:
    """One pivotal step: move word mass between the open item and ``x`` until one is integral."""
    a, b = state["open"], x
    mass_a, room_a = a["size"] * a["p"], a["size"] * (1 - a["p"])
    mass_b, room_b = b["size"] * b["p"], b["size"] * (1 - b["p"])
    up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
    u = unit_hash(a["id"], b["id"], F.lit(seed), F.lit(level))
    rises = F.when(up + down > 0, u < F.try_divide(down, up + down)).otherwise(a["p"] >= 0.5)

    def item(of, p):
        return F.struct(of["id"].alias("id"), of["own"].alias("own"), of["size"].alias("size"), p.cast("double").alias("p"))

    def result(still_open, closed):
        return F.struct(still_open.alias("open"), F.concat(state["done"], F.array(closed)).alias("done"))

    one, zero = F.lit(1.0), F.lit(0.0)
    rise = F.when(room_a <= mass_b, result(item(b, b["p"] - up / b["size"]), item(a, one))).otherwise(
        result(item(a, a["p"] + up / a["size"]), item(b, zero))
    )
    fall = F.when(mass_a <= room_b, result(item(b, b["p"] + down / b["size"]), item(a, zero))).otherwise(
        result(item(a, a["p"] - down / a["size"]), item(b, one))
    )
    first = F.struct(item(x, x["p"]).alias("open"), state["done"].alias("done"))
    return F.when(a.isNull(), first).when(rises, rise).otherwise(fall)


def _fold(items: DataFrame, keys: list[str], seed: int, level: int) -> DataFrame:
    """Per block: ``open``, the one item that may still be fractional, and ``done``, the decided ones."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("by"), F.xxhash64("id", F.lit(seed)).alias("tie"), "id", "own", "size", "p")))
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    folded = F.aggregate("items", start, lambda s, x: _pair(s, x, seed, level))
    return items.groupBy(*keys).agg(order.alias("items")).select(*keys, folded.alias("f")).select(*keys, "f.open", "f.done")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    A document of a source with ratio r = target / source_size gets floor(r) copies and one
    more with the probability of r's fraction. The fractional copies are rounded together:
    inside a block of about ``BLOCK`` documents of one source, two open documents exchange
    word mass (size times probability) until one is decided, up or down with the odds that
    keep every document's expected copies; each block passes on the one document still open,
    and those are paired in blocks again, level by level. So the words taken of a source
    differ from its target by less than one document, whose copy is rounded to the nearer side.
    All random numbers are hashes of ids: reruns agree. Blocks are dealt by hash, so a source
    that holds a third of all rows is as spread out as any other, and every array is of
    about ``BLOCK`` items.

    Edge cases: null text has size 0; documents of size 0 take no words; null is a source of
    its own; rows that share an id, source and size are decided together, and rows without an
    id are told apart by their texts; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    found = _decide(docs, id_col, text_col, source_col, weights, cap, seed)
    return found.select("doc_id", "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def _key(doc_id: Column, text: Column) -> Column:
    """What stands for a row's id: the id, or a hash of the text where there is none."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def _decide(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``key``, ``size``, ``source``, ``source_size``, ``target``, ``copies``.

    Rows that agree in key, source and size have the same copies.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _key(F.col(id_col), F.col(text_col)).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        F.col(source_col).alias("source"),
    )
    rows = materialise(rows, "mix-items")
    targets = materialise(source_targets(rows, weights, cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumnRenamed("source", "_s")
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "doc_id", "key", "size", "source", "source_size", "target", ratio.alias("ratio")
    )
    base, part = F.floor("ratio"), F.col("ratio") - F.floor("ratio")
    alike = rows.where((F.col("size") > 0) & (part > 0)).groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("rows"), F.max(part).alias("p"))
    items = alike.select("source", F.col("key").alias("id"), F.col("size").alias("own"), (F.col("size") * F.col("rows")).alias("size"), "p")
    decided = _round(items, seed)
    keyed = decided.select(F.col("source").alias("_s"), F.col("id").alias("_id"), F.col("own").alias("_own"), "extra")
    out = rows.join(keyed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_id")) & (F.col("size") == F.col("_own")), "left")
    copies = F.when(F.col("size") > 0, base + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "key", "size", "source", "source_size", "target", copies.alias("copies"))


def _round(items: DataFrame, seed: int) -> DataFrame:
    """(source, id, own, extra): every item of ``items`` (source, id, own, size, p) rounded to 0 or 1."""
    decided, level = None, 0
    left = materialise(items, "mix-level0")
    while True:
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        blocks = F.ceil(F.col("n") / BLOCK)
        dealt = (
            left.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), blocks))
            .select("source", "block", "id", "own", "size", "p")
        )
        folded = _fold(dealt, ["source", "block"], seed, level)
        last = most <= BLOCK
        if not last:
            folded = materialise(folded, f"mix-fold{level}")
        closed = folded.select("source", F.explode("done").alias("x")).select("source", "x.id", "x.own", F.col("x.p").cast("int").alias("extra"))
        decided = closed if decided is None else decided.unionByName(closed)
        if last:
            rounded = folded.where("open is not null").select("source", "open.id", "open.own", (F.col("open.p") >= 0.5).cast("int").alias("extra"))
            return decided.unionByName(rounded)
        left = materialise(folded.where("open is not null").select("source", "open.id", "open.own", "open.size", "open.p"), f"mix-level{level + 1}")
        level += 1


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, with all their columns.

    A row meets its copies by what ``mix`` decides by: id (or text), source and size. Edge cases
    as in ``mix``; rows of size 0 are not taken.
    """
    key, size, source, times = fresh("key"), fresh("size"), fresh("source"), fresh("copies")
    taken = _decide(docs, id_col, text_col, source_col, weights, cap, seed).where("copies > 0")
    taken = taken.select(F.col("key").alias(key), F.col("size").alias(size), F.col("source").alias(source), F.col("copies").alias(times)).distinct()
    mine = (_key(F.col(id_col), F.col(text_col)) == F.col(key)) & (word_count(F.col(text_col)) == F.col(size))
    met = docs.join(taken, mine & F.col(source_col).eqNullSafe(F.col(source)))
    repeated = met.withColumn(fresh("copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
