"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in two halves, each quantised on its own by k-means, so a cell is a pair
of centroids and squared distances add up over the halves. A query takes cells in the order
of the summed distance of its halves to their centroids, by a heap, until these hold as many
entries as the index found necessary for the recall asked for; all entries of these cells
are ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.shared import BATCH_ROWS, arrow_rows, lean, materialise, small_batches, unit_hash

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 16_384
#: Vectors among these whose true neighbours tell how far a query has to go.
TRIALS = 256
#: Share of the trials' true neighbours that have to lie in the cells visited.
RECALL = 0.97
#: Centroids of a half, at most.
WIDEST = 256
#: Entries of a block that queries meet in one task, and queries that meet it there, at most.
BLOCK, GUESTS = 8192, 32_768
#: Queries whose similarities to a block are held at a time.
STRIP = 128
#: More than the rounding of a similarity, so that no true neighbour is left out before the exact measure.
SLACK = 1e-9


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves, entries of each cell, entries a query has to visit, and the written entries.

    ``entries`` has row, id, vector (array<double>), cell. The cells' numbers are at most
    ``WIDEST`` squared.
    """

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    visits: int
    entries: DataFrame

    @property
    def width(self) -> int:
        return len(self.halves[0])

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The first block of each cell, and over how many its entries are dealt: small cells share one, large ones have several."""
        first, parts = np.zeros(len(self.counts), "int64"), np.maximum(1, -(-self.counts // BLOCK))
        block = filled = 0
        for cell, n in enumerate(self.counts):
            if filled and filled + n > BLOCK:
                block, filled = block + 1, 0
            first[cell] = block
            filled += n
            if n > BLOCK:
                block, filled = block + int(parts[cell]), 0
        return first, parts


def usable(vector: Column) -> Column:
    """Whether a vector takes part: there, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows, each divided by a power of two, which changes no cosine and lets no square overflow."""
    found = np.stack(vectors.to_numpy()).astype("float64")
    return np.ldexp(found, -np.frexp(np.abs(found).max(axis=1, keepdims=True))[1])


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def units(vectors: pd.Series) -> np.ndarray:
    rows = matrix(vectors)
    return rows / norms(rows)[:, None]


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(1), 0)


def fit_half(rows: np.ndarray, width: int, rounds: int = 12) -> np.ndarray:
    """``width`` centroids by k-means that starts from distinct rows, spread evenly over the sample."""
    distinct = np.unique(rows, axis=0)
    start = np.random.default_rng(0).permutation(len(distinct))
    centroids = distinct[np.resize(start, width)].copy()
    for _ in range(rounds):
        nearest = distances(rows, centroids).argmin(1)
        for k in range(width):
            if len(own := rows[nearest == k]):
                centroids[k] = own.mean(0)
    return centroids


def traverse(near: np.ndarray, far: np.ndarray, counts: np.ndarray, visits: int) -> list[int]:
    """Cells with entries, by the sum of the two halves' distances, until they hold ``visits`` entries.

    The heap holds the pairs at the border of those taken: a pair enters once both pairs
    before it, in either half, have been taken.
    """
    width = len(near)
    by_near, by_far = np.argsort(near, kind="stable").tolist(), np.argsort(far, kind="stable").tolist()
    a, b, held = near[by_near].tolist(), far[by_far].tolist(), counts.tolist() if isinstance(counts, np.ndarray) else counts
    taken_in_row = [0] * (width + 1)  # pairs of a row are taken from the left
    heap, found, seen = [(a[0] + b[0], 0, 0)], [], 0
    while heap and seen < visits:
        _, i, j = heappop(heap)
        taken_in_row[i] = j + 1
        cell = by_near[i] * width + by_far[j]
        if held[cell]:
            found.append(cell)
            seen += held[cell]
        if i + 1 < width and taken_in_row[i + 1] == j:
            heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < width and (i == 0 or taken_in_row[i - 1] > j + 1):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return found


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then least id (null last), then least row."""
    missing = pd.isna(ids)
    return np.lexsort((rows, np.where(missing, 0, ids), missing, -scores))[:k]


class Near:
    """The k best entries seen so far of each of a few query vectors."""

    def __init__(self, rows: np.ndarray, own: np.ndarray, k: int):
        self.rows, self.own, self.k, self.best = rows, own, k, [[] for _ in own]

    def see(self, rows: np.ndarray, keys: np.ndarray, cells: np.ndarray) -> None:
        likeness = self.rows @ rows.T
        for n, scores in enumerate(likeness):
            scores[keys == self.own[n]] = -np.inf
            top = np.argpartition(-scores, self.k)[: self.k] if len(scores) > self.k else np.arange(len(scores))
            self.best[n] = sorted(self.best[n] + [(-scores[x], int(keys[x]), int(cells[x])) for x in top if scores[x] > -np.inf])[: self.k]


def _needed(index: MultiIndex, trials: pd.DataFrame, k: int, recall: float) -> int:
    """Entries to visit so that the share ``recall`` of the trials' true neighbours is among them.

    The trials are few; each task compares its entries with all of them and passes on k for each.
    """
    rows, own = units(trials["vector"]), trials["row"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = Near(rows, own, k)
        for batch in batches:
            near.see(units(batch["vector"]), batch["row"].to_numpy(), batch["cell"].to_numpy())
        yield pd.DataFrame([(n, -s, r, c) for n, best in enumerate(near.best) for s, r, c in best], columns=["trial", "score", "row", "cell"])

    each = index.entries.select("row", "vector", "cell").mapInPandas(lean(run), "trial int, score double, row long, cell int")
    top = Window.partitionBy("trial").orderBy(F.desc("score"), "row")
    true = each.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).toPandas()  # TRIALS times k rows at most
    half, needed = index.halves[0].shape[1], []
    for trial, cells in true.groupby("trial")["cell"]:
        row = rows[trial : trial + 1]
        sums = (distances(row[:, :half], index.halves[0])[0][:, None] + distances(row[:, half:], index.halves[1])[0][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        reached = np.empty(len(order), "int64")
        reached[order] = np.cumsum(index.counts[order])
        needed += reached[cells.to_numpy()].tolist()
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def build(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, recall: float = RECALL) -> MultiIndex | None:
    """The index of every usable row of ``vectors``; None if there is none.

    Centroids are fitted on about ``SAMPLE`` rows chosen by a hash of their content, and how
    many entries a query has to visit on the true neighbours of ``TRIALS`` of them. Rows of
    another length than the commonest take no part.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vector.alias("vector")).where(usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not length:
        return None
    size, n = length[0]["length"], length[0]["count"]
    rows = materialise(rows.where(F.size("vector") == size).select(F.monotonically_increasing_id().alias("row"), "id", "vector"), "vectors")
    order = F.xxhash64("id", "vector", "row")
    picked = rows.where(unit_hash(F.col("id"), F.col("vector"), F.col("row"), F.lit("sample")) < F.lit(min(1.0, SAMPLE / n))).limit(2 * SAMPLE)
    sample = picked.withColumn("_h", order).toPandas().sort_values(["_h", "row"], ignore_index=True)  # bounded by SAMPLE
    if sample.empty:
        sample = rows.limit(1).withColumn("_h", order).toPandas()
    width = 2 ** int(min(np.log2(WIDEST), max(1, round(np.log2(max(n, 1) / 50) / 2))))
    fitted, half = units(sample["vector"]), size // 2
    halves = (fit_half(fitted[:, :half], width), fit_half(fitted[:, half:], width))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = units(batch["vector"])
            yield batch.assign(cell=(distances(unit[:, :half], halves[0]).argmin(1) * width + distances(unit[:, half:], halves[1]).argmin(1)).astype("int32"))

    with arrow_rows(vectors.sparkSession, BATCH_ROWS):
        entries = materialise(rows.mapInPandas(lean(assign), f"row long, id {rows.schema['id'].dataType.simpleString()}, vector array<double>, cell int"), "multi-index")
    counts = np.zeros(width * width, "int64")
    for r in entries.groupBy("cell").count().collect():  # WIDEST squared at most
        counts[r["cell"]] = r["count"]
    small_batches(vectors.sparkSession)
    found = MultiIndex(halves, counts, 1, entries)
    return MultiIndex(halves, counts, _needed(found, sample.head(TRIALS), k, recall), entries)


def _visits(index: MultiIndex, queries: DataFrame) -> DataFrame:
    """(block, row, id, vector, cells): each query once for each block that has cells it visits."""
    (near, far), counts, most = index.halves, index.counts.tolist(), index.visits
    first, parts = index.blocks()
    half = near.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit, out = units(batch["vector"]), []
            left, right = distances(unit[:, :half], near), distances(unit[:, half:], far)
            for n in range(len(batch)):
                met: dict[int, list[int]] = {}
                for cell in traverse(left[n], right[n], counts, most):
                    for part in range(parts[cell]):
                        met.setdefault(int(first[cell]) + part, []).append(cell)
                out += [(n, block, cells) for block, cells in met.items()]
            found = pd.DataFrame(out, columns=["n", "block", "cells"])
            yield pd.DataFrame({"block": found["block"].astype("int64"), **{c: batch[c].to_numpy()[found["n"].astype("int64")] for c in ("row", "id", "vector")}, "cells": found["cells"]})

    kind = queries.schema["id"].dataType.simpleString()
    return queries.select("row", "id", "vector").mapInPandas(lean(run), f"block long, row long, id {kind}, vector array<double>, cells array<int>")


def _ranked(batch: pd.DataFrame, block: dict, k: int) -> list[tuple]:
    """(query row, query id, id, row, score) of the k best of a block for each query of ``batch``, among the cells it visits."""
    out, rows, lengths = [], block["rows"], block["norms"]
    for start in range(0, len(batch), STRIP):
        part = batch.iloc[start : start + STRIP]
        asked = matrix(part["vector"])
        asked_norms = norms(asked)
        likeness = (asked @ rows.T) / asked_norms[:, None] / lengths
        for n, (own, query_id, cells) in enumerate(zip(part["row"], part["id"], part["cells"], strict=True)):
            open_cells = np.zeros(len(block["cells"]), bool)
            open_cells[np.searchsorted(block["cells"], cells)] = True
            scores = np.where(np.repeat(open_cells, block["sizes"]) & (block["keys"] != own), likeness[n], -np.inf)
            least = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
            near = np.flatnonzero((scores >= least - SLACK) & (scores > -np.inf))
            exact = (rows[near] * asked[n]).sum(axis=1) / (lengths[near] * asked_norms[n])
            ids, keys = block["ids"][near], block["keys"][near]
            out += [(own, query_id, ids[x], keys[x], exact[x]) for x in _best(exact, ids, keys, k)]
    return out


def search(index: MultiIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_row, query_id, rank, id, score): the k nearest entries found for each of ``queries`` (rows of the index).

    Each block of entries meets the queries that visit it, in as many tasks as these need; a
    task holds one block and passes queries along it in Arrow batches.
    """
    spark, entries = queries.sparkSession, index.entries
    kind = entries.schema["id"].dataType.simpleString()
    visits = materialise(_visits(index, queries), "visits")
    tasks = visits.groupBy(F.col("block").alias("_block")).agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("_tasks"))
    first, parts = index.blocks()
    places = spark.createDataFrame(pd.DataFrame({"_cell": np.arange(len(first)), "_first": first, "_parts": parts})[index.counts > 0])  # WIDEST squared at most
    dealt = entries.join(F.broadcast(places), F.col("cell") == F.col("_cell")).withColumn("block", F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_parts")))
    guests = visits.join(tasks, F.col("block") == F.col("_block")).select("block", F.pmod(F.xxhash64("row"), F.col("_tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), "row", "id", "vector", F.lit(0).alias("cell"), "cells")
    hosts = dealt.join(tasks, F.col("block") == F.col("_block")).select("block", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "row", "id", "vector", "cell", F.lit(None).cast("array<int>").alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for batch in batches:
            out = []
            for key, part in batch.groupby(["block", "task"], sort=False):
                if key != at:
                    at, held, block = key, [], None
                if len(own := part[part["kind"] == 0]):
                    held.append(own)
                if len(asked := part[part["kind"] == 1]):
                    if block is None:
                        own = pd.concat(held).sort_values("cell", kind="stable")
                        rows, (cells, sizes) = matrix(own["vector"]), np.unique(own["cell"], return_counts=True)
                        block, held = {"rows": rows, "norms": norms(rows), "cells": cells, "sizes": sizes, "keys": own["row"].to_numpy(), "ids": own["id"].to_numpy()}, []
                    out += _ranked(asked, block, k)
            yield pd.DataFrame(out, columns=["query_row", "query_id", "id", "row", "score"])

    both = guests.unionByName(hosts).repartition("block", "task").sortWithinPartitions("block", "task", "kind")
    near = both.mapInPandas(lean(run), f"query_row long, query_id {kind}, id {kind}, row long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of ``vectors`` found for those that ``asked``, a condition on ``id``, holds for.

    Nearness is the cosine in double precision on the original vectors; ties go to the smaller
    id. A query's own row is no candidate. About the share ``recall`` of the true neighbours is
    found: as many entries are visited as trial queries needed for it.

    Edge cases: vectors that are null, zero or hold null or non-finite components take no part,
    nor do those of another length than the commonest; rows with equal ids or equal vectors
    are rows of their own; null ids are candidates, last among ties; with fewer than ``k``
    candidates all found are given; an empty table gives an empty result; other columns are
    ignored.
    """
    index = build(vectors, id_col, vector_col, k, recall)
    kind = vectors.schema[id_col].dataType.simpleString()
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    return search(index, index.entries.where(asked), k).drop("query_row")
