"""The inverted multi-index against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.llm import multi_index as M
from stratamem.sources.tables import table

SCHEMA = "vec_id long, embedding array<double>, row long, cell int, vector string, block int, kind int"


def exact(rows, k=5):
    """{place of the query row: [(id, score)]} of the true neighbours, by brute force."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for n, (i, q) in enumerate(rows):
        if i is not None and i % 50 == 0:
            near = [(float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for m, (j, v) in enumerate(rows) if m != n]
            near.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out[n] = [(j, s) for s, j in near[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").collect()
    got = entry.queries()["op12_multi_index"](spark, d).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    by_query, true = {}, exact([tuple(r) for r in rows])
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    hits = 0
    for n, near in true.items():
        query_id = rows[n]["vec_id"]
        own = sorted(by_query[query_id], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        for r in own:
            q, v = vectors[query_id], vectors[r["vec_id"]]
            assert r["vec_id"] != query_id
            assert math.isclose(r["score"], q @ v / (np.linalg.norm(q) * np.linalg.norm(v)), abs_tol=1e-12)
        hits += len({r["vec_id"] for r in own} & {j for j, _ in near})
    assert len(by_query) == len(true)
    assert hits >= 0.9 * 5 * len(true)


def clusters(seed: int, n: int, hot: int):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(hot)]


@pytest.mark.parametrize("block,guests", [(M.BLOCK, M.GUESTS), (40, 3)])
def test_copies_and_small_blocks(spark, monkeypatch, block, guests):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "GUESTS", guests)
    rows = clusters(1, 600, 300)  # a third of all rows are one vector
    frame = spark.createDataFrame([(*r, 1, 2, "v", 3, 4) for r in rows], SCHEMA).repartition(5)
    got = {}
    for r in M.nearest(frame, F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    true = {rows[n][0]: near for n, near in exact(rows).items()}
    assert got.keys() == true.keys()
    hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in near}) for q, near in true.items())
    assert hits >= 0.9 * 5 * len(true)
    hot = [q for q in true if true[q][0][1] > 1 - 1e-12]
    assert hot and all([got[q][n][0] for n in range(1, 6)] == [i for i, _ in true[q]] for q in hot)  # ties to the smaller id


def test_edge_cases(spark):
    bad = [(100, None), (150, []), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 0.0]), (300, [float("nan"), 1.0, 0.0]), (350, [float("inf"), 1.0, 0.0]), (400, [1.0, 2.0])]
    good = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.1, 0.0]), (None, [1.0, 0.1, 0.0]), (7, [1e300, 1e299, 0.0]), (50, [0.0, 0.0, 1e-300])]
    rows = [(*r, 1, 2, "v", 3, 4) for r in bad + good]
    got = M.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 50}
    assert sorted(r["rank"] for r in got if r["query_id"] == 0) == [1, 1, 2, 2, 3, 3, 4, 4]  # both rows of id 0 ask, and find each other
    assert all(not math.isnan(r["score"]) for r in got)
    assert M.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0
    assert M.nearest(spark.createDataFrame(rows[:7], SCHEMA).where("vec_id < 400"), F.col("id") % 50 == 0).count() == 0
    assert M.nearest(spark.createDataFrame([(50, [1.0], 1, 2, "v", 3, 4)], SCHEMA), F.col("id") % 50 == 0).count() == 0  # no other row


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(4)
    for _ in range(50):
        near, far = rng.random(6), rng.random(6)
        counts = rng.integers(0, 4, 36)
        found = M.traverse(near, far, counts, int(counts.sum()))
        sums = (near[:, None] + far[None, :]).ravel()
        assert found == [c for c in np.argsort(sums, kind="stable") if counts[c]]
        part = M.traverse(near, far, counts, 10)
        assert part == found[: len(part)] and counts[part].sum() >= 10 and counts[part[:-1]].sum() < 10
