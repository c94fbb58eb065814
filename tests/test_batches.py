"""Ingest over micro-batches gives what one batch gives, run again or not."""

from __future__ import annotations

import pytest

from stratamem.operators import ingest
from stratamem.plans import flow_queries
from stratamem.sources import delta
from stratamem.sources.tables import table
from stratamem.streaming import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("episodes", "pages", "edges", "evidence")


def rows_of(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def messages(spark):
    return flow_queries._messages(table(spark, SF, "events")).where("uuid % 3 = 0").cache()


@pytest.fixture(scope="module")
def sessions(spark):
    return flow_queries._sessions(spark, SF)


@pytest.fixture(scope="module")
def whole(messages, sessions):
    episodes = ingest.record(messages, sessions).cache()
    found = dict(zip(TABLES, (episodes, *ingest.maintain(episodes)), strict=True))
    return {name: (frame.columns, rows_of(frame, frame.columns)) for name, frame in found.items()}


def cut(messages, n):
    bounds = messages.selectExpr("unix_micros(cast(min(created_at) as timestamp)) a", "unix_micros(cast(max(created_at) as timestamp)) b").first()
    places = [bounds["a"] + (bounds["b"] + 1 - bounds["a"]) * k // n for k in range(n + 1)]
    return [messages.where(f"unix_micros(cast(created_at as timestamp)) >= {a} and unix_micros(cast(created_at as timestamp)) < {b}") for a, b in zip(places, places[1:], strict=False)]


def test_batches_run_again(spark, tmp_path, messages, sessions, whole):
    root = f"file://{tmp_path}/t"
    tables = Q.ingest_tables(spark, root)
    for n, part in enumerate(cut(messages, 3)):
        Q.ingest_batch(tables, sessions, part, n)
        Q.ingest_batch(tables, sessions, part, n)  # as after a crash before the checkpoint had it
        if n == 1:
            tables.compact(n)
            Q.ingest_batch(tables, sessions, part, n)  # even after the batches before it were compacted
    found = Q.ingested(spark, root)
    for name in TABLES:
        assert rows_of(found[name], whole[name][0]) == whole[name][1], name


def test_stream_with_a_restart(spark, tmp_path, messages, sessions, whole):
    root, source = f"file://{tmp_path}/t", f"file://{tmp_path}/in"
    for some in (cut(messages, 4)[:2], cut(messages, 4)[2:]):
        for part in some:
            part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
        Q.ingest(stream, sessions, root, compact_every=2)
    base, deltas = Q.ingest_tables(spark, root).versions()
    assert base == "base-2" and deltas == ["delta-3"]
    found = Q.ingested(spark, root)
    for name in TABLES:
        assert rows_of(found[name], whole[name][0]) == whole[name][1], name


def test_nothing_is_seen_before_the_marker(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    tables = delta.DeltaTables(spark, root, {"a": delta.kept_last(["k"]), "b": None})
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert tables.read("a") is None
    tables.commit(0, {"a": rows, "b": rows})
    spark.createDataFrame([(1, "z", 1)], "k int, v string, version long").write.parquet(f"{root}/a/delta-1")  # a crash between two tables
    assert rows_of(tables.read("a"), ["k", "v"]) == [(1, "x"), (2, "y")]
    tables.commit(1, {"a": rows.where("k = 1").selectExpr("k", "'z' as v"), "b": rows.limit(0)})
    assert rows_of(tables.read("a"), ["k", "v"]) == [(1, "z"), (2, "y")]
    assert rows_of(tables.read("a", before=1), ["k", "v"]) == [(1, "x"), (2, "y")]
    tables.compact(2)
    assert tables.versions() == ("base-1", []) and rows_of(tables.read("a"), ["k", "v"]) == [(1, "z"), (2, "y")] and tables.read("b").count() == 2
