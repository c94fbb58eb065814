"""Rules whose results are written out: canonical JSON, metrics without relevant ids, what a session wakes up with, transcripts, rooms."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stratamem.functions import guard, text
from stratamem.operators import evaluation, sessions
from stratamem.sources import readers

VALUES = [
    {"cmd": 'a"b', "z": "é", "a": "tab\t, line\n, bell\x07, back\\slash"},
    {"nested": {"b": [1, 2.5, None, True, {"y": "🙂", "x": ""}], "a": {}}, "A": []},
    {"sep": "a, b: c", "big": 12345678901234567890, "neg": -0.5, "日本": "語"},
    {},
]


@pytest.mark.parametrize("value", VALUES)
def test_canonical_json(spark, value):
    body = json.dumps(value, sort_keys=True)
    frame = spark.createDataFrame([(json.dumps(value, ensure_ascii=False, separators=(",", ":")),)], "j string")
    row = frame.select(guard.canonical_json("j").alias("c"), guard.canonical_hash(F.parse_json("j")).alias("v")).first()
    assert row["c"] == body
    if "big" not in value:
        assert row["v"] == hashlib.sha256(body.encode()).hexdigest()


def test_canonical_hash_of_maps(spark):
    frame = spark.createDataFrame([({"b": {"y": "é", "x": None}, "a": {}},), (None,)], "m map<string, map<string, string>>")
    got = [r["h"] for r in frame.select(guard.canonical_hash(F.col("m")).alias("h")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ('{"a": {}, "b": {"x": null, "y": "\\u00e9"}}', "{}")]
    assert spark.createDataFrame([("no json",)], "j string").select(guard.canonical_json("j").alias("c")).first()["c"] is None


def test_queries_without_relevant_ids_score_nothing(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "x", 1), (3, "y", 1)], "query_id int, id string, rank int")
    qrels = spark.createDataFrame([(1, "a"), (4, "b")], "query_id int, id string")
    queries = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "query_id int")
    got = {r["query_id"]: r for r in evaluation.metrics(ranks, qrels, (1,), queries).collect()}
    assert {q: (r["p_1"], r["r_1"], r["ndcg_1"], r["rr"]) for q, r in got.items()} == {1: (1.0, 1.0, 1.0, 1.0), 2: (0.0,) * 4, 3: (0.0,) * 4, 4: (0.0,) * 4}
    assert evaluation.summary(evaluation.metrics(ranks, qrels, (1,), queries)).first()["mrr"] == 0.25
    labels = spark.createDataFrame([(1, "p"), (10, "p"), (2, "alone"), (3, None)], "id int, label string")
    found = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 10, 1)], "query_id int, id int, rank int")
    by = evaluation.by_label(found, labels, spark.createDataFrame([(1,), (2,), (3,), (9,)], "query_id int"), (1,))
    assert sorted((r["query_id"], r["rr"], r["r_1"]) for r in by.collect()) == [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (9, 0.0, 0.0)]


def test_wake_up_costs_what_is_printed(spark):
    rows = [("g", "deals", 1, 0.9, "plan", "signed the deal"), ("g", "auth", 2, 0.5, None, "y" * 130), ("g", "deals", 3, 0.4, "fact", "  later  "), ("g", "auth", 4, 0.3, "fact", ""), ("h", "ui", 5, 0.1, "fact", "z")]
    items = spark.createDataFrame(rows, "group_id string, room string, id long, score double, type string, text string")
    woken = sessions.wake_up(items, 500)
    # heading 29 characters; header "\n**deals:**" 11; "[plan] signed the deal" 22; "[fact] later" 12; "\n**auth:**" 10; "[fact] " and 123 characters 130
    assert [(r["id"], r["spent"]) for r in woken.where("group_id = 'g'").orderBy("spent").collect()] == [(1, 7 + 2 + 5), (3, 14 + 3), (2, 17 + 2 + 32)]
    texts = {r["group_id"]: r["text"] for r in sessions.wake_up_text(woken).collect()}
    assert texts["g"] == f"## Key Context (last 30 days)\n\n**deals:**\n- [plan] signed the deal\n- [fact] later\n\n**auth:**\n- [fact] {'y' * 120}..."
    assert texts["h"] == "## Key Context (last 30 days)\n\n**ui:**\n- [fact] z"
    assert [r["id"] for r in sessions.wake_up(items, 20).where("group_id = 'g'").orderBy("spent").collect()] == [1, 3]
    assert [r["id"] for r in sessions.wake_up(items, 500, most=1).orderBy("id").collect()] == [1, 5]


def test_transcript_lines(spark, tmp_path):
    lines = [
        {"type": "user", "content": "by type"},
        {"message": {"type": "user", "content": "x" * 251}},
        {"role": "user", "content": " two\nlines "},
        {"message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": ""}, {"type": "text", "text": "b"}]}},
        {"role": "user", "message": {"role": "assistant", "content": "not the user's"}},
        {"role": "user", "content": "y" * 250},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["", "{broken", "  "]))
    got = readers.transcript(spark, f"file://{tmp_path}/t.jsonl").orderBy("position").collect()
    assert [r["text"] for r in got] == ["by type", "x" * 247 + "...", "two lines", "a b", "y" * 250]
    assert {r["total"] for r in got} == {7}


def test_rooms_are_a_parameter(spark):
    rooms = {"auth": ("login", "password"), "data": ("table", "login"), "long": ("subscription",)}
    frame = spark.createDataFrame([("login login",), ("Password reset",), ("one table",), ("subscription",), (None,), ("table table login",)], "t string")
    assert [r["r"] for r in frame.select(text.room(F.col("t"), rooms).alias("r")).collect()] == ["auth", "auth", "general", "long", "general", "data"]
