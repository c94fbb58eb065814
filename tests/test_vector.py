"""Vector search over pivots against brute force, and ranks of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.operators import rank, vector


def plain(queries, vectors, k, least, include_self):
    out = {}
    for q, x in queries:
        near = [(-float(vector.alike(vector.unit([x]), vector.unit([v]))[0, 0]), i) for i, v in vectors if include_self or i != q]
        out[q] = [(i, -s) for s, i in sorted(near)[:k] if -s >= least]
    return out


@pytest.mark.parametrize("held,guests", [(vector.BLOCK, vector.GUESTS), (30, 4)])
@pytest.mark.parametrize("include_self,least", [(True, 0.0), (False, 0.9)])
def test_nearest_is_whole(spark, monkeypatch, held, guests, include_self, least):
    monkeypatch.setattr(vector, "BLOCK", held)
    monkeypatch.setattr(vector, "GUESTS", guests)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=6)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)] + [(900, [0.0] * 6), (901, (-centres[0]).tolist())]
    asked = rows[:40] + rows[-2:]
    got = vector.nearest(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(rows, "id long, vector array<double>"), 7, least, include_self)
    found = {q: [] for q, _ in asked}
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["id"], r["similarity"]))
    assert found == plain(asked, rows, 7, least, include_self)


def test_cells_are_left_out(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    rows = spark.createDataFrame([(i, (centres[i % 30] + 0.05 * rng.normal(size=8)).tolist()) for i in range(900)], "id long, vector array<double>")
    index = vector.build(rows).pivots
    limit = np.sqrt(4 * (1 - 0.99))
    bounds = index.bounds(vector.unit(rows.limit(60).toPandas()["vector"].tolist()))
    assert (index.counts * (bounds <= limit)).sum() < 0.2 * 60 * index.counts.sum()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert vector.nearest(none.withColumnRenamed("id", "query_id"), none, 3).count() == 0


def test_rank_along_all_rows(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANGE_ROWS", 20)
    rows = spark.range(333).select("id", (F.col("id") * 37 % 11).alias("x"))
    got = {r["id"]: r["n"] for r in rank.along(rows, "n", F.desc("x"), F.asc("id")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda e: e[1])] == sorted(range(333), key=lambda i: (-(i * 37 % 11), i)) and sorted(got.values()) == list(range(1, 334))
    assert rank.along(rows.limit(0), "n", F.asc("id")).count() == 0
