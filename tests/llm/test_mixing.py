from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.llm import mixing, shared
from stratamem.sources.tables import table
from tests.llm import cases


def brute_targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """The iterative rule, as stated: share, stop what is above, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / share for s in names}
        above = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("rows", [2, 1 << 16])
def test_targets_follow_the_rule(spark, monkeypatch, rows):
    monkeypatch.setattr(shared, "RANGE_ROWS", rows)
    sizes = {"a": 5, "b": 1000, "c": 7, "Z": 300, "é": 2, None: 40, "d": 0}
    items = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(items).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_meets_its_contract(spark, sf):
    d = f"/root/testdata/{sf}"
    query = entry.queries()["op1_mixing"]
    found = query(spark, d).toPandas()
    docs = {r["doc_id"]: r for r in table(spark, d, "documents").collect()}
    assert sorted(found["doc_id"]) == sorted(docs)
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert all(len(words.findall(docs[i]["text"] or "")) == n for i, n in zip(found["doc_id"], found["size"]))
    assert (found["taken"] <= 3 * found["size"]).all()
    source = found["doc_id"].map(lambda i: docs[i]["source"])
    targets = brute_targets(dict(found.groupby(source)["size"].sum()))
    taken = found.groupby(source)["taken"].sum()
    largest = found.groupby(source)["size"].max()
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5 * largest[s] + 1
        assert found[source == s]["target"].iloc[0] == pytest.approx(target)
    again = query(spark, d).toPandas().set_index("doc_id")["taken"]
    assert (again.loc[found["doc_id"]].to_numpy() == found["taken"].to_numpy()).all()


def test_copies_are_unbiased(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2]) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen, runs = Counter(), 30
    for seed in range(runs):
        for r in mixing.mix(frame, seed=seed).collect():
            seen[r["doc_id"]] += r["copies"]
    ratio = {s: t / sum(1 + i % 9 for i in range(40) if "ab"[i % 2] == s) for s, t in brute_targets({"a": sum(1 + i % 9 for i in range(0, 40, 2)), "b": sum(1 + i % 9 for i in range(1, 40, 2))}).items()}
    for s in "ab":
        mean = sum(seen[i] for i in range(40) if "ab"[i % 2] == s) / runs / 20
        assert mean == pytest.approx(ratio[s], abs=0.1)
    assert any(0 < seen[i] / runs % 1 < 1 for i in range(40))


def test_many_levels_keep_the_mass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") < 250, "hot").alias("source"))
    found = mixing.mix(frame).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(found) == 2
    assert all(abs(r["taken"] - r["target"]) <= 7 for r in found)


def test_edge_cases(spark):
    found = mixing.mix(cases.docs(spark)).collect()
    assert len(found) == len(cases.rows())
    assert all(r["taken"] == r["copies"] * r["size"] for r in found)
    assert len({r["copies"] for r in found if r["doc_id"] == 13}) == 1
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mixed_rows_repeat(spark):
    source = cases.docs(spark).where("doc_id <> 13")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(source).collect()}
    mixed = mixing.mixed_rows(source)
    assert mixed.columns == source.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mixing.mixed_rows(cases.empty(spark)).count() == 0


def test_mixed_rows_follow_the_mix_under_null_and_repeated_ids(spark):
    rows = [(None, f"n{i} " * (1 + i % 9), "ab"[i % 2]) for i in range(60)]
    rows += [(i % 5, f"t{i} " * (1 + i % 7), "abc"[i % 3]) for i in range(90)]
    rows += [(7, "same text", None), (7, "same text", None), (None, "twice the same", None), (None, "twice the same", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    decided = Counter()
    for r in mixing.mix(frame).collect():
        decided[(r["doc_id"], r["size"], r["target"])] += r["copies"]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target = brute_targets(dict(sizes))
    taken = mixing.mixed_rows(frame).collect()
    got = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in taken)
    wanted = {(i, n, s): c for (i, n, t), c in decided.items() for s in target if t == pytest.approx(target[s]) and c}
    assert got == wanted
    assert any(i is None for i, _, _ in got)
    for s, words in target.items():
        assert abs(sum(n * c for (_, n, of), c in got.items() if of == s) - words) <= 9


def test_a_row_not_taken_is_not_taken_under_a_repeated_id(spark):
    rows = [(1, "w " * 3, "a"), (1, "w " * 5, "b"), (2, "w " * 40, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r["size"]: r["copies"] for r in mixing.mix(frame, weights=(1, 20)).collect()}
    got = Counter(len(r["text"].split()) for r in mixing.mixed_rows(frame, weights=(1, 20)).collect())
    assert len({copies[3], copies[5]}) == 2
    assert got == Counter({n: c for n, c in copies.items() if c})
