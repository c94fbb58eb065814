"""Composed search against a plain pass over the same channels."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stratamem.operators import keyword, search, vector

QUESTIONS = [
    (1, "tell me about the red harbor fox", "general"),
    (2, "red fox", "general"),
    (3, "how does Jacob know Harbor about Alice", "multi_hop"),
    (4, "what happened yesterday with the fox", "temporal"),
    (5, "  ", None),
]


def vec(n):
    return [math.cos(n), math.sin(n), 0.1]


def test_depths_follow_the_limit():
    assert search.Depths.of(1) == search.Depths(20, 10, 30)
    assert search.Depths.of(40) == search.Depths(120, 80, 200)
    with pytest.raises(ValueError):
        search.Depths.of(0)


def test_plans_by_intent(spark):
    rows = search.planned(spark.createDataFrame([q[:2] for q in QUESTIONS], "query_id long, text string")).collect()
    assert {r["query_id"]: (r["intent"], r["expands"], r["walks"]) for r in rows} == {
        1: ("general", True, False),
        2: ("general", False, False),
        3: ("multi_hop", False, True),
        4: ("temporal", False, False),
    }


def test_variants_count_once_and_only_where_asked(spark):
    asked = search.planned(spark.createDataFrame([(n, t, vec(n)) for n, t, _ in QUESTIONS], "query_id long, text string, vector array<double>"))
    variants = [(1, 1, "another way", vec(9)), (1, 2, " Another WAY", vec(8)), (1, 3, QUESTIONS[0][1].upper(), vec(8)), (1, 4, "beyond", vec(7)), (2, 1, "short", vec(7)), (3, 1, "linked", vec(7)), (1, 2, "", vec(6))]
    index = vector.build(spark.createDataFrame([(i, vec(i / 7)) for i in range(40)], "id long, vector array<double>"))
    found = search.by_vector(asked, spark.createDataFrame(variants, "query_id long, variant int, text string, vector array<double>"), index, 5)
    counts = {(r["query_id"], r["channel"]): r["n"] for r in found.groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {(1, "vector 0"): 5, (1, "vector 1"): 5, (2, "vector 0"): 5, (3, "vector 0"): 5, (4, "vector 0"): 5}


@pytest.mark.parametrize("limit", [3, 40])
def test_compose(spark, limit):
    rng = random.Random(limit)
    channels = {(q, c): rng.sample(range(80), 50) for q in (1, 2) for c in ("a", "b", "c")}
    truth = {i: rng.choice([None, "", "x" * 10, "x" * 400]) for i in range(0, 80, 2)}
    degree = {i: rng.choice([None, 0, 3]) for i in truth}
    model = {i: rng.choice([None, 0.1, 0.5, 0.9]) for i in range(70)}
    from stratamem.functions import fixed as V

    wanted = set()
    for q in (1, 2):
        scores = {}
        for (asked, _), ids in channels.items():
            for n, i in enumerate(ids, 1):
                if asked == q:
                    scores[i] = scores.get(i, 0) + 1 / (V.RRF_K + n)
        for i in scores:
            scores[i] *= V.TRUTH_FACTOR if len((truth.get(i) or "").strip()) >= V.TRUTH_CHARS else 1
            scores[i] = round(scores[i] + (V.BACKLINK_WEIGHT * math.log(1 + degree[i]) if degree.get(i) else 0), 9)
        stay = sorted((-s, i) for i, s in scores.items() if i < 70 and i % 5)
        head = sorted(stay[:30], key=lambda x: (model[x[1]] is None, -(model[x[1]] or 0), x))
        wanted |= {(q, i, -s, n) for n, (s, i) in enumerate([*head, *stay[30:]][:limit], 1)}
    rankings = spark.createDataFrame([(q, c, i, n) for (q, c), ids in channels.items() for n, i in enumerate(ids, 1)], "query_id long, channel string, id long, rank int")
    pages = spark.createDataFrame([(i, truth[i], degree[i]) for i in truth], "id long, truth string, in_degree long")
    episodes = spark.createDataFrame([(i, model[i]) for i in range(70)], "id long, sure double")
    found = search.compose(rankings, pages, episodes, limit, F.col("id") % 5 != 0, F.col("sure"))
    assert {tuple(r) for r in found.collect()} == wanted


def test_the_whole_path(spark):
    docs = [(i, f"the fox number{i} at the harbor" if i % 2 else f"nothing number{i}") for i in range(30)]
    rows = spark.createDataFrame(docs, "id long, text string")
    questions = spark.createDataFrame([(n, t, vec(n)) for n, t, _ in QUESTIONS], "query_id long, text string, vector array<double>")
    none = spark.createDataFrame([], "query_id long, variant int, text string, vector array<double>")
    vectors = spark.createDataFrame([(i, vec(i)) for i in range(1, 5)], "id long, vector array<double>")
    vertices = spark.createDataFrame([("p", None), ("d20", 20), ("d22", 22), ("d24", 24)], "node string, id long")
    edges = spark.createDataFrame([("d20", "p"), ("d22", "d20")], "src string, dst string")
    seeds = spark.createDataFrame([(3, "p"), (1, "p")], "query_id long, node string")
    pages = rows.select("id", F.col("text").alias("truth"), F.lit(0).alias("in_degree"))
    found = search.search(questions, none, vectors, keyword.build(rows), None, (vertices, edges, seeds), pages, rows, 20, rounds=10)
    ids = {q: {r["id"] for r in found.where(F.col("query_id") == q).collect()} for q in range(1, 6)}
    near = {1, 2, 3, 4}
    assert {20, 22} <= ids[3] and 24 not in ids[3] and not {20, 22} & (ids[1] | ids[2] | ids[4])  # only a question that links entities walks
    assert all(near <= ids[q] for q in range(1, 5)) and not ids[5]
    assert ids[2] - near and all(i % 2 for i in ids[2] - near)
