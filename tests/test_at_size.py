"""What shows on larger tables only: times within a day's first second, tables of several files, bounded memory."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.functions import score
from stratamem.operators import extract, ingest, keyword, vector


def test_age_counts_parts_of_a_second(spark):
    times = ["2024-01-11 00:00:00.636583", "2024-01-11 00:00:00", "2024-01-10 23:59:59.999999", "2024-02-03 00:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", score.age_days(F.col("t").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("age"))
    assert {r["t"]: r["age"] for r in rows.collect()} == dict(zip(times, [20, 21, 21, 0], strict=True))


def test_a_stream_reads_a_folder_of_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = entry.queries()["stream_first_replies"](spark, f"file://{tmp_path}")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(c.execute(entry.oracle_sql()["stream_first_replies"]).fetchall()) != []


def test_what_a_task_sends_is_bounded():
    rows = pd.DataFrame({"id": range(3000), "vector": [np.ones(4)] * 3000})
    parts = list(vector.sent(rows, np.ones((3000, 40), bool)))
    assert max(map(len, parts)) <= 8192 and sum(map(len, parts)) == 120_000
    assert max(map(len, vector.strips([rows]))) <= 1024 and sum(map(len, vector.strips([rows]))) == 3000


def test_groups_share_a_block_of_cells():
    pivots = vector.Pivots(np.random.default_rng(3).normal(size=(40, 4)), np.full(40, vector.BLOCK // 4), np.zeros(40), np.ones(40))
    assert len(set(pivots.homes())) == 10 and len(set(pivots.homes(5))) == 2


def test_best_by_single_precision_is_exact():
    rng = np.random.default_rng(4)
    left, right = (vector.unit(rng.normal(size=(n, 16)).tolist()) for n in (30, 500))
    right[100:160], right[7] = right[3], np.nan
    ids = rng.permutation(500)
    for least in (0.0, 0.6):
        near = np.where(ids == ids[:30, None], -1.0, vector.alike(left, right))
        wanted = [[(ids[j], near[i, j]) for j in np.lexsort((ids, -near[i]))[:9] if near[i, j] >= least] for i in range(30)]
        row, column, found = vector.best(left, right, 9, ids, ids[:30], np.full(30, least))
        assert [list(zip(ids[column[row == i]], found[row == i], strict=True)) for i in range(30)] == wanted


def test_a_block_is_scored_where_its_postings_lie(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 3}") for i in range(300)], "id long, text string")
    index = keyword.build(docs)
    by_block = index.postings.groupBy("block", "id").count()
    assert "Exchange" not in by_block._jdf.queryExecution().executedPlan().toString()
    assert keyword.search(spark.createDataFrame([(1, "common word3")], "query_id long, text string"), index, 5).hits.count() == 5


def test_a_frequent_token_does_not_meet_in_one_task(spark):
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(1, "common word3 nowhere else")], "query_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more questions
    try:
        found = keyword.overlap(asked, docs)
        assert "hashpartitioning(token" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["score"] for r in found.collect()} == {i: 0.5 if i == 3 else 0.25 for i in range(60)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_text_is_judged_once(spark):
    notes = spark.createDataFrame([(1, "Ada Vale met us just now", None)], "uuid long, content string, episode_type string")
    plan = extract.entity_references(notes)._jdf.queryExecution().optimizedPlan().toString()
    # sessions' and agents' patterns: where a kind decides, and where none does
    assert plan.count(r"\bjust now\b") == 2 and plan.count(r"\bauto[- ]?memory\b") == 2


def test_pages_read_the_messages_once(spark, monkeypatch):
    written, labels = ingest.written, []
    monkeypatch.setattr(ingest, "written", lambda rows, label: labels.append((label, rows._jdf.queryExecution().optimizedPlan().toString())) or written(rows, label))
    pages = entry.queries()["ingest_pages"](spark, "/root/testdata/sf0.001")
    assert {r["slug"] for r in pages.collect()}
    assert [label for label, plan in labels if "events.parquet" in plan or "event_id" in plan] == ["mentioning"]
    assert all("Join" not in plan for label, plan in labels if label != "mentioning")


def test_recorded_episodes_are_not_judged_again(spark):
    rows = [(1, "assistant should ask Ada Vale", True), (2, "we met Ada Vale", False)]
    recorded = spark.createDataFrame(rows, "uuid long, content string, misrouted boolean").withColumn("episode_type", F.lit(None).cast("string"))
    found = extract.entity_references(recorded)
    assert r"\bjust now\b" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["uuid"] for r in found.collect()) == [2] == sorted(r["uuid"] for r in extract.entity_references(recorded.drop("misrouted")).collect())
