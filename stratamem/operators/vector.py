"""Exact nearest neighbours by cosine over an index of pivots.

On unit vectors cosine orders as Euclidean distance does, which obeys the triangle
inequality: a vector in a pivot's cell, at a distance from the pivot between the cell's
least and greatest, can't be nearer to a query than the query's own distance to the pivot
tells. A query first meets the cells that look nearest, which bounds its k-th hit, and then
only those cells that could still hold a nearer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.operators.rank import top_k
from stratamem.sources.scratch import written

#: Guests that one comparison in numpy takes.
STRIP = 128
#: Rows that are held against all pivots at once, and visits that leave a task at once.
ROWS, VISITS = 1024, 8192
#: Hosts that guests meet at once where the first near one is looked for.
STEP = 256
#: More than single precision can take from a cosine of unit vectors.
COARSE = 1e-4
#: Vectors of a cell that one task holds; larger cells are dealt over several.
BLOCK = 8192
#: Queries that meet a block of a cell in one task, at most.
GUESTS = 32_768
#: Pivots, at most.
MOST_PIVOTS = 1024
#: More than rounding similarities to 9 digits can hide, in squared distance.
SLACK = 1e-8


@dataclass(frozen=True)
class Pivots:
    """Unit pivots, and per cell how many vectors it has and their least and greatest distance from the pivot."""

    centres: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def homes(self, groups: int = 1) -> np.ndarray:
        """The block of each cell: neighbours along the widest direction share one, up to ``BLOCK`` vectors for each of ``groups``."""
        centred = self.centres - self.centres.mean(axis=0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
        found, block, filled = np.zeros(len(along), "int32"), 0, 0
        for cell in np.argsort(along, kind="stable"):
            if filled and filled + self.counts[cell] > BLOCK * groups:
                block, filled = block + 1, 0
            found[cell] = block
            filled += self.counts[cell]
        return found

    def bounds(self, unit_rows: np.ndarray) -> np.ndarray:
        """For each row and cell a distance that no vector of the cell is nearer than."""
        far = apart(unit_rows, self.centres)
        found = np.maximum(0.0, np.maximum(far - self.most, self.least - far))
        found[:, self.counts == 0] = np.inf
        return found


@dataclass(frozen=True)
class Index:
    """``pivots``, and the written vectors with their ``cell``."""

    pivots: Pivots
    cells: DataFrame


def alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity (1 + cos) / 2 of each unit vector on the left to each on the right, to 9 digits."""
    return np.round(np.maximum(0.0, 1 - (1 - left @ right.T) / 2), 9)


def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distance of each row on the left to each on the right."""
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1) - 2 * left @ right.T
    return np.sqrt(np.maximum(0.0, squares))


def best(left: np.ndarray, right: np.ndarray, k: int, ids: np.ndarray, but: np.ndarray | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the ``k`` unit vectors on the right most alike to each on the left, by ``least`` of
    the row or more; ties go to the lesser of ``ids``, and the column with the id in ``but`` is left out.

    Single precision rules out most pairs; those left are told apart in double precision.
    """
    coarse = left.astype("float32") @ right.astype("float32").T
    floor = (2 * least - 1 - COARSE).astype("float32")
    if k + 1 < coarse.shape[1] and (coarse >= floor[:, None]).sum() > 8 * k * len(left):
        told = np.where(np.isnan(coarse), np.float32(-2), coarse)
        floor = np.maximum(floor, np.partition(told, -k - 1, axis=1)[:, -k - 1] - np.float32(COARSE))  # one more, as one may be left out
    row, column = np.nonzero(coarse >= floor[:, None])
    if but is not None:
        others = ids[column] != but[row]
        row, column = row[others], column[others]
    near = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", left[row[n : n + VISITS]], right[column[n : n + VISITS]]) for n in range(0, len(row), VISITS))])
    near = np.round(np.maximum(0.0, 1 - (1 - near) / 2), 9)
    fit = near >= least[row]
    row, column, near = row[fit], column[fit], near[fit]
    order = np.lexsort((ids[column], -near, row))
    row, column, near = row[order], column[order], near[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k], near[place < k]


def first(left: np.ndarray, right: np.ndarray, until: np.ndarray, least: float) -> np.ndarray:
    """For each unit vector on the left the first of the ``until`` first on the right that is alike by ``least`` or more; -1 for none."""
    found, open_ = np.full(len(left), -1), np.arange(len(left))
    for start in range(0, int(until.max(initial=0)), STEP):
        open_ = open_[(found[open_] < 0) & (until[open_] > start)]
        if not len(open_):
            break
        some = right[start : start + STEP]
        near = (alike(left[open_], some) >= least) & (start + np.arange(len(some)) < until[open_][:, None])
        met = near.any(axis=1)
        found[open_[met]] = start + near[met].argmax(axis=1)
    return found


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows]) if rows else np.zeros((0, 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def spread(rows: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` rows, each the farthest from those before it, so that cells are narrow."""
    found, far = [0], apart(rows, rows[:1])[:, 0]
    while len(found) < min(n, len(rows)):
        found.append(int(far.argmax()))
        far = np.minimum(far, apart(rows, rows[found[-1] : found[-1] + 1])[:, 0])
    return found


def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches``, up to ``ROWS`` at once."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.iloc[start : start + ROWS]


def sent(rows: pd.DataFrame, near: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each of ``rows`` once for each block that it is ``near`` (as ``cell``), up to ``VISITS`` at once, however many blocks there are."""
    row, block = np.nonzero(near)
    for start in range(0, len(row), VISITS):
        yield rows.iloc[row[start : start + VISITS]].assign(cell=block[start : start + VISITS].astype("int32"))


def build(vectors: DataFrame) -> Index | None:
    """The index of ``vectors`` (id, vector, and what else there is); None if there are none. Pivots are some of the vectors, about the square root of their number."""
    rows = vectors.where("vector is not null").withColumns({"id": F.col("id").cast("long"), "vector": F.col("vector").cast("array<double>")})
    rows = written(rows, "vectors")
    n = rows.count()
    if not n:
        return None
    wanted = int(min(MOST_PIVOTS, max(1, np.sqrt(n))))
    share = F.shiftrightunsigned(F.xxhash64("id", "vector"), 11).cast("double") / F.lit(float(1 << 53))
    sample = rows.where(share < min(1.0, 4 * wanted / n)).limit(8 * wanted).toPandas()  # a few for each pivot
    sample = sample if len(sample) else rows.limit(1).toPandas()
    distinct = np.unique(unit(sample.sort_values("id")["vector"].tolist()), axis=0)
    centres = distinct[spread(distinct, wanted)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in strips(batches):
            far = apart(unit(batch["vector"].tolist()), centres)
            nearest = far.argmin(axis=1)
            yield batch.assign(cell=nearest.astype("int32"), far=far[np.arange(len(far)), nearest])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    cells = written(rows.mapInPandas(assign, f"{schema}, cell int, far double"), "cells")
    counts, least, most = np.zeros(len(centres), "int64"), np.zeros(len(centres)), np.zeros(len(centres))
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect():  # MOST_PIVOTS rows
        counts[r["cell"]], least[r["cell"]], most[r["cell"]] = r["n"], r["least"], r["most"]
    # a distance is exact to about the square root of a double's precision
    return Index(Pivots(centres, counts, least - 1e-7, most + 1e-7), cells)


def _dealt(pivots: Pivots, visits: DataFrame, hosts: DataFrame, group: bool) -> DataFrame:
    """Vectors of ``hosts`` (kind 0) and the ``visits`` that meet them (kind 1), each block with its guests in one task, hosts first.

    A block has ``BLOCK`` vectors of a cell at most, a task ``GUESTS`` visits; with ``group``
    vectors of different groups do not meet.
    """
    keys = ["cell", "group"] if group else ["cell"]
    deals = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("_tasks"))
    sizes = hosts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    met = deals.join(sizes, keys).select(*(F.col(c).alias(f"_{c}") for c in keys), "_tasks", "_blocks")
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    columns = [c for c in visits.columns if c not in keys]
    block, task = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("_tasks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = visits.join(met, same).select(*keys, every("_blocks").alias("block"), task.alias("task"), F.lit(1).alias("kind"), *columns)
    right = hosts.join(met, same).select(*keys, block.alias("block"), every("_tasks").alias("task"), F.lit(0).alias("kind"), *columns)
    place = [*keys, "block", "task"]
    return left.unionByName(right).repartition(*place).sortWithinPartitions(*place, "kind")


def _pairs(batches: Iterator[pd.DataFrame], keys: list[str], ready) -> Iterator[tuple]:
    """(``ready`` of a block's hosts, some of its guests) along rows in the order of ``_dealt``."""
    at, held, block = None, [], None
    for batch in batches:
        for key, part in batch.groupby(keys, sort=False):
            if key != at:
                at, held, block = key, [], None
            own, asked = part[part["kind"] == 0], part[part["kind"] == 1]
            if len(own):
                held.append(own)
            if len(asked) and (held or block is not None):
                if block is None:
                    block, held = ready(pd.concat(held)), []
                for first in range(0, len(asked), STRIP):
                    yield block, asked.iloc[first : first + STRIP]


def of_blocks(cells: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """For each row the blocks that have one of its cells."""
    found = np.zeros((len(cells), int(homes.max()) + 1), bool)
    row, cell = np.nonzero(cells)
    found[row, homes[cell]] = True
    return found


def at_home(rows: DataFrame, homes: np.ndarray) -> DataFrame:
    """``rows`` with their block in the place of their ``cell``."""
    return rows.withColumn("cell", F.element_at(F.array(*(F.lit(int(x)) for x in homes)), F.col("cell") + 1))


def _met(index: Index, visits: DataFrame, k: int, include_self: bool) -> DataFrame:
    """(query_id, id, similarity): the ``k`` best of each block for each of ``visits`` (id, vector, cell, least), from their ``least`` on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (ids, rows), some in _pairs(batches, ["cell", "block", "task"], lambda own: (own["id"].to_numpy(), unit(own["vector"].tolist()))):
            names = some["id"].to_numpy()
            row, column, near = best(unit(some["vector"].tolist()), rows, k, ids, None if include_self else names, some["least"].to_numpy(dtype="float64"))
            yield pd.DataFrame({"query_id": names[row], "id": ids[column], "similarity": near})

    hosts = index.cells.select("cell", "id", "vector", F.lit(None).cast("double").alias("least"))
    return _dealt(index.pivots, visits, at_home(hosts, index.pivots.homes()), group=False).mapInPandas(run, "query_id long, id long, similarity double")


def first_near(pivots: Pivots, guests: DataFrame, hosts: DataFrame, least: float) -> DataFrame:
    """(id, host): for each of ``guests`` the first of ``hosts`` in the order of (pos, id) that comes before it in
    its group and is alike by ``least`` or more. Both are (cell, id, group, pos, vector), rows of an index; no pair is a row."""
    limit = np.sqrt(max(0.0, 4 * (1 - least)) + SLACK)

    groups = hosts.agg(F.approx_count_distinct("group").alias("n")).first()["n"]
    homes = pivots.homes(max(1, groups))  # vectors of other groups do not meet in a block

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in strips(batches):
            yield from sent(batch, of_blocks(pivots.bounds(unit(batch["vector"].tolist())) <= limit, homes))

    def ready(own: pd.DataFrame) -> tuple:
        own = own.sort_values(["pos", "id"])
        return own["pos"].to_numpy(), own["id"].to_numpy(), unit(own["vector"].tolist())

    def before(places: np.ndarray, ids: np.ndarray, pos: np.ndarray, names: np.ndarray) -> np.ndarray:
        """How many of the hosts, in order, come before each guest."""
        order = np.lexsort((np.concatenate([ids, names]), np.concatenate([places, pos])))  # a guest that is a host comes after itself
        hosts_so_far = np.cumsum(order < len(places))
        found = np.empty(len(order), "int64")
        found[order] = hosts_so_far
        found = found[len(places) :]
        own = found - 1
        return found - ((own >= 0) & (places[own] == pos) & (ids[own] == names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (places, ids, rows), some in _pairs(batches, ["cell", "group", "block", "task"], ready):
            pos, names = some["pos"].to_numpy(), some["id"].to_numpy()
            host = first(unit(some["vector"].tolist()), rows, before(places, ids, pos, names), least)
            met = host >= 0
            yield pd.DataFrame({"id": names[met], "pos": places[host[met]], "host": ids[host[met]]})

    columns = ["cell", "group", "id", "pos", "vector"]
    visits = guests.select(*columns).mapInPandas(visit, "cell int, group long, id long, pos long, vector array<double>")
    found = _dealt(pivots, visits, at_home(hosts.select(*columns), homes), group=True).mapInPandas(run, "id long, pos long, host long")
    return found.groupBy("id").agg(F.min(F.struct("pos", "host"))["host"].alias("host"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.0, include_self: bool = True, index: Index | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most alike vectors of each query, similarity (1 + cos) / 2.

    ``queries`` (query_id, vector) meet cells of the index of ``vectors`` (id, vector) in two
    passes: cells that look nearest, until they hold ``k`` vectors besides the query itself,
    then those that the k-th hit so far, or ``least``, does not rule out. Queries travel as
    rows; only pivots and numbers of cells are broadcast. Similarities are rounded to 9
    digits, ties go to the lesser id.
    """
    index = index or build(vectors)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    pivots, farthest = index.pivots, np.sqrt(max(0.0, 4 * (1 - least)) + SLACK)  # similarity s is a squared distance of 4 (1 - s)

    homes = pivots.homes()

    def visited(second: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in strips(batches):
                bounds = pivots.bounds(unit(batch["vector"].tolist()))
                order = np.argsort(bounds, axis=1, kind="stable")
                before = np.cumsum(pivots.counts[order], axis=1) - pivots.counts[order]
                first_ = np.zeros(bounds.shape, bool)
                np.put_along_axis(first_, order, before <= k, 1)
                near = of_blocks(first_ & (bounds <= farthest) & np.isfinite(bounds), homes)
                lows = np.full(len(batch), least)
                if second:
                    lows = np.maximum(least, batch["bound"].to_numpy(dtype="float64"))
                    limit = np.sqrt(np.maximum(0.0, 4 * (1 - batch["bound"].to_numpy(dtype="float64"))) + SLACK)
                    near = of_blocks((bounds <= np.minimum(limit, farthest)[:, None]) & np.isfinite(bounds), homes) & ~near
                yield from sent(pd.DataFrame({"id": batch["query_id"].to_numpy(), "vector": batch["vector"].to_numpy(), "least": lows}), near)

        return run

    schema = "id long, vector array<double>, least double, cell int"
    some = written(_met(index, asked.mapInPandas(visited(False), schema), k, include_self), "near")
    some = top_k(some, ["query_id"], k, F.desc("similarity"), F.asc("id"))
    bound = some.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("similarity").alias("bound"))
    left = asked.join(bound, F.col("query_id") == F.col("_q"), "left").select("query_id", "vector", F.coalesce("bound", F.lit(0.0)).alias("bound"))
    more = _met(index, left.mapInPandas(visited(True), schema), k, include_self)
    return top_k(some.drop("rank").unionByName(more), ["query_id"], k, F.desc("similarity"), F.asc("id"))
