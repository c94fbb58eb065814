"""Handoffs are seen whole or not at all, and once for each key."""

from __future__ import annotations

import datetime as dt

import pytest

from stratamem.operators import handoff

SCHEMA = "request_id long, group_id string, session_id string, task string, data string, idempotency_key string, at timestamp"
START = dt.datetime(2024, 1, 1)


def asked(spark, *rows):
    return spark.createDataFrame([(i, g, s, f"task {i}", "{}", key, START + dt.timedelta(minutes=m)) for i, g, s, key, m in rows], SCHEMA)


def saved(found):
    return {r["request_id"]: r for r in found.collect()}


def test_second_save_returns_the_first_ids(spark, tmp_path):
    store = handoff.tables(spark, f"file://{tmp_path}/h")
    one = saved(handoff.save(store, asked(spark, (1, "g", "s1", "k", 0), (2, "g", "s2", None, 0), (3, "h", "s3", "k", 0))))
    assert not any(r["hit"] for r in one.values())
    two = saved(handoff.save(store, asked(spark, (4, "g", "s4", "k", 40), (5, "g", "s5", None, 40), (6, "g", "s6", "k", 80))))
    assert two[4]["hit"] and (two[4]["episode_id"], two[4]["snapshot_id"], two[4]["session_id"]) == (one[1]["episode_id"], one[1]["snapshot_id"], "s1")
    assert not two[5]["hit"] and not two[6]["hit"]
    again = saved(handoff.save(store, asked(spark, (1, "g", "s1", "k", 0), (4, "g", "s4", "k", 40))))
    assert all(r["hit"] and r["episode_id"] == one[1]["episode_id"] for r in again.values())
    assert [store.read(t).count() for t in handoff.TABLES] == [5, 5, 10, 5]
    assert {r["edge_type"] for r in store.read("edges").collect()} == {"HAS_SNAPSHOT", "PRODUCED_HANDOFF"}
    assert {(r["session_id"], r["status"]) for r in store.read("sessions").collect()} == {(f"s{n}", "handoff") for n in (1, 2, 3, 5, 6)}


def test_a_crash_between_two_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    store = handoff.tables(spark, f"file://{tmp_path}/h")
    whole = handoff._deltas

    def half(new):
        found = whole(new)
        found["edges"] = found["edges"].selectExpr("*", "raise_error('lost') as gone")
        return found

    monkeypatch.setattr(handoff, "_deltas", half)
    with pytest.raises(Exception, match="lost"):
        handoff.save(store, asked(spark, (1, "g", "s1", "k", 0)))
    assert all(store.read(t) is None for t in handoff.TABLES)
    monkeypatch.setattr(handoff, "_deltas", whole)
    assert not saved(handoff.save(store, asked(spark, (1, "g", "s1", "k", 0))))[1]["hit"]
    assert [store.read(t).count() for t in handoff.TABLES] == [1, 1, 2, 1]


def test_of_two_writers_one_is_first(spark, tmp_path):
    store, others = handoff.tables(spark, f"file://{tmp_path}/h"), []

    def meanwhile():
        if not others:
            others.append(None)
            others[0] = saved(handoff.save(handoff.tables(spark, f"file://{tmp_path}/h"), asked(spark, (1, "g", "s1", "k", 0))))[1]

    mine = saved(handoff.save(store, asked(spark, (2, "g", "s2", "k", 5), (3, "g", "s3", "own", 5)), before_commit=meanwhile))
    assert mine[2]["hit"] and mine[2]["episode_id"] == others[0]["episode_id"] and not mine[3]["hit"]
    assert [store.read(t).count() for t in handoff.TABLES] == [2, 2, 4, 2]
