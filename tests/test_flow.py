"""Snapshots, digests and ingest against plain Python."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.functions import forms
from stratamem.operators import compaction, graph, ingest
from stratamem.sources import sinks

SNAPSHOT = "id long, task string, status string, " + ", ".join(f"{n} array<string>" for n in forms.LISTS)


def popped(snapshot, most):
    snapshot = {k: list(v) if isinstance(v, list) else v for k, v in snapshot.items()}
    for key in ("completed", "in_progress", "next_steps", "key_decisions"):
        while len(json.dumps(snapshot)) > most and len(snapshot[key]) > 1:
            snapshot[key].pop()
    return snapshot


@pytest.mark.parametrize("most", [100, 400, 900, 5000])
def test_snapshot_cap(spark, most):
    rng = random.Random(most)
    words = ["plain", 'quo"te', "back\\slash", "tab\tline\n", "é", "日本", "🙂", "\x01", "", "a longer piece of text"]
    snapshots = [{"task": rng.choice(words), "status": rng.choice([None, "done"]), **{n: rng.choices(words, k=rng.randint(0, 25)) for n in forms.LISTS}} for _ in range(40)]
    frame = spark.createDataFrame([(i, *s.values()) for i, s in enumerate(snapshots)], SNAPSHOT)
    sizes = {r["id"]: r["n"] for r in frame.select("id", forms.snapshot_length().alias("n")).collect()}
    assert [sizes[i] for i in range(40)] == [len(json.dumps(s)) for s in snapshots]
    found = {r["id"]: r for r in forms.capped(frame, most).collect()}
    for i, s in enumerate(snapshots):
        wanted = popped(s, most)
        assert {n: found[i][n] for n in forms.LISTS} == {n: wanted[n] for n in forms.LISTS}


def test_context_block(spark):
    frame = spark.createDataFrame([(1, "Ship it", None, ["a", "b"], [], ["c"], [], [], ["x.py", "y.py"])], SNAPSHOT)
    block = frame.select(forms.context_block(F.lit(None).cast("string")).alias("b")).first()["b"]
    assert block.split("\n") == [
        "## Session State (from previous session)", "**Device:** unknown", "**Task:** Ship it", "**Status:** unknown",
        "**Completed:**", "  - a", "  - b", "**Next Steps:**", "  - c", "**Files Modified:** x.py, y.py", "",
    ]


def test_rerank_text(spark):
    frame = spark.createDataFrame([(None, " \t", "second", "third"), ("x" * 2000, "", "", ""), (None, None, None, "")], "a string, b string, c string, d string")
    assert [r["t"] for r in frame.select(forms.rerank_text("a", "b", "c", "d").alias("t")).collect()] == ["second", "x" * 1500, ""]


def test_daily_digest(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, f"text {i % 30}", [float(x) for x in rng.normal(size=3)], None, None) for i in range(50)]
    rows += [(1, 100, "text 1", [1.0, 0.0, 0.0], None, None), (1, 101, "other", [1.0, 0.01, 0.0], None, None), (1, 102, "gone", [1.0, 0.0, 0.0], "archived", None), (1, 103, "run", [1.0, 0.0, 0.0], None, "r"), (1, 104, "bare", None, None, None)]
    frame = spark.createDataFrame(rows, "group long, uuid long, content string, vector array<double>, lifecycle_status string, daily_run string")
    now = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    frame = frame.withColumn("created_at", now - F.make_dt_interval(mins=F.lit(600) - F.col("uuid").cast("int")))
    wanted = {}
    for group in (0, 1):
        mine = [r for r in rows if r[0] == group and r[4] is None and r[5] is None]
        first = {}
        for r in mine:
            if r[2] in first:
                wanted[r[1]] = (first[r[2]], "exact")
            else:
                first[r[2]] = r[1]
        left = [r for r in mine if r[1] not in wanted and r[3] is not None]
        for n, a in enumerate(left):
            for b in left[n + 1 :] if a[1] not in wanted else []:
                cos = np.dot(a[3], b[3]) / np.linalg.norm(a[3]) / np.linalg.norm(b[3])
                if b[1] not in wanted and (1 + cos) / 2 >= 0.88:
                    wanted[b[1]] = (a[1], "semantic")
    merges = compaction.daily_digest(frame, now)
    assert {r["uuid"]: (r["merged_into"], r["step"]) for r in merges.collect()} == wanted
    assert compaction.digest_stats(frame, merges).first()["merged_count"] == len(wanted)


def test_ingest_maintains_pages(spark):
    text = "Ada Vale founded Harbor Labs because the plan was good, and the startup Harbor Labs shipped."
    schema = "uuid long, session_id long, content string, episode_type string, group_id string, agent_id string, surface string, importance double, created_at timestamp_ntz"
    rows = [(1, 7, f"we decided: {text}", None, None, None, "cli", None, None), (2, 7, "too short", None, None, None, None, None, None), (3, 8, f"so: {text}", "fact", "own", "me", None, 0.1, None)]
    sessions = spark.createDataFrame([(7, "team", 4)], "session_id long, group_id string, episode_count long")
    episodes = ingest.record(spark.createDataFrame(rows, schema), sessions)
    got = {r["uuid"]: r for r in episodes.collect()}
    assert set(got) == {1, 3}
    assert (got[1]["group_id"], got[1]["agent_id"], got[1]["session_order"], got[1]["importance"]) == ("team", "cli", 4, 0.8)
    assert (got[3]["group_id"], got[3]["agent_id"], got[3]["session_order"], got[3]["episode_type"]) == ("own", "me", 0, "fact")
    assert {r["session_id"]: r["episode_count"] for r in ingest.counted(sessions, episodes).collect()} == {7: 5}
    pages, edges, evidence = ingest.maintain(episodes)
    assert {r["slug"]: r["domain"] for r in pages.collect()}["harbor-labs"] == "topic"  # by its first mention
    assert ("ada-vale", "FOUNDED", "harbor-labs") in {(r["from_slug"], r["edge_type"], r["to_slug"]) for r in edges.collect()}
    assert {("harbor-labs", 1), ("harbor-labs", 3)} <= {(r["slug"], r["uuid"]) for r in evidence.collect()}


def test_pages_with_a_token_inside(spark):
    tokens = spark.createDataFrame([("vale",), ("a",), ("lab",), ("",), ("zz",)], "token string")
    pages = spark.createDataFrame([(1, "ada-vale"), (2, "harbor-labs"), (3, ""), (4, "vale")], "page long, slug string")
    found = {tuple(r) for r in graph.pages_with(tokens, pages).collect()}
    assert found == {("vale", 1), ("vale", 4), ("a", 1), ("a", 2), ("a", 4), ("lab", 2)}


def test_schema_plan_is_idempotent(spark):
    wanted = spark.createDataFrame([("index", "a"), ("index", "b")], "kind string, name string")
    there = wanted.where("name = 'a'")
    plan = sinks.plan_schema(wanted, there, ["kind", "name"])
    after = sinks.apply_schema(there, plan)
    assert sinks.plan_schema(wanted, after, ["kind", "name"]).count() == 0
    assert [r["name"] for r in sinks.apply_schema(after, plan, undo=True).collect()] == ["a"]
