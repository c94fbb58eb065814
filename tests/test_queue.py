"""The queue's limits and transitions, and closures over trees."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratamem.operators import jobs, trees



def now():
    return F.expr("timestamp_ntz '2024-02-01 00:00:00'")


REQUEST = "job_id long, name string, idempotency_key string, parent_id long, timeout_seconds int, max_attempts int, scheduled_at timestamp_ntz"
JOB = "job_id long, name string, idempotency_key string, parent_id long, depth int"


def submitted(spark, known, asked):
    found = jobs.submit(spark.createDataFrame(known, JOB), spark.createDataFrame(asked, REQUEST), now())
    return {r["request_id"]: r for r in found.collect()}


def request(i, name="echo", key=None, parent=None, timeout=60, tries=3):
    return (i, name, key, parent, timeout, tries, None)


def test_submission(spark):
    known = [(1, "echo", "k", None, 0), (2, "deep", None, 1, 8), (3, "echo", None, 1, 7)] + [(100 + i, "child", None, 7, 1) for i in range(254)] + [(7, "many", None, None, 0)]
    asked = [request(10), request(11, key="k"), request(12, name="other", key="k"), request(13, key="n"), request(14, key="n"), request(15, name=""), request(16, timeout=0), request(17, tries=0)]
    asked += [request(18, parent=999), request(19, parent=2), request(20, parent=3), request(21, parent=7), request(22, parent=7), request(23, parent=7)]
    got = submitted(spark, known, asked)
    assert (got[10]["job_id"], got[10]["created"], got[10]["depth"]) == (10, True, 0)
    assert (got[11]["job_id"], got[11]["created"]) == (1, False)
    assert (got[12]["job_id"], got[12]["created"]) == (12, True)
    assert (got[13]["job_id"], got[14]["job_id"], got[14]["created"]) == (13, 13, False)
    assert [got[i]["reason"] for i in range(15, 24)] == ["name", "timeout_seconds", "max_attempts", "parent_id", "depth", None, None, None, "children"]
    assert got[20]["depth"] == 8 and got[23]["job_id"] is None


def one_by_one(known, asked):
    """The queue as it takes requests in turn: (job_id, reason, created) of each."""
    jobs_, keys, children = {j[0]: j[4] for j in known}, {}, {}
    for j in known:
        if j[2] is not None:
            keys.setdefault((j[1], j[2]), j[0])
        if j[3] is not None:
            children[j[3]] = children.get(j[3], 0) + 1
    out, old = {}, set(jobs_)
    for i, name, key, parent, timeout, tries, _ in sorted(asked):
        reason = "name" if not name else "timeout_seconds" if timeout <= 0 else "max_attempts" if tries < 1 else None
        if reason is None and parent is not None:
            reason = "parent_id" if parent not in old else "depth" if jobs_[parent] + 1 > 8 else "children" if children.get(parent, 0) >= 256 else None
        if reason:
            out[i] = (None, reason, False)
        elif key is not None and (name, key) in keys:
            out[i] = (keys[name, key], None, False)
        else:
            if key is not None:
                keys[name, key] = i
            if parent is not None:
                children[parent] = children.get(parent, 0) + 1
            out[i] = (i, None, True)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batch_is_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    known = [(n, "top", f"k{n}" if n < 4 else None, None, 0) for n in range(1, 7)]
    known += [(10_000 * p + i, "child", None, p, 1) for p in range(1, 7) for i in range(256 - rng.randrange(6))]
    asked = [request(200_000 + i, rng.choice(["a", "top", ""]) if i % 9 == 0 else "a", rng.choice([None, *(f"k{n}" for n in range(12))]), rng.choice([None, 1, 2, 3, 4, 5, 6, 999]), rng.choice([60, 60, 0])) for i in range(150)]
    got = {i: (r["job_id"], r["reason"], r["created"]) for i, r in submitted(spark, known, asked).items()}
    assert got == one_by_one(known, asked)


def test_key_of_a_refused_request_passes_on(spark):
    known = [(1, "full", None, None, 0), (2, "free", None, None, 0)] + [(100 + i, "child", None, 1, 1) for i in range(255)]
    asked = [request(1000, parent=1), request(1001, key="k", parent=1), request(1002, key="k", parent=2), request(1003, key="k")]
    got = submitted(spark, known, asked)
    assert [(got[i]["job_id"], got[i]["reason"], got[i]["created"]) for i in range(1000, 1004)] == [(1000, None, True), (None, "children", False), (1002, None, True), (1002, None, False)]


STATE = "job_id long, queue int, status string, attempts int, max_attempts int, priority int, scheduled_at timestamp_ntz, claimed_at timestamp_ntz, worker_id string, parent_id long, failed_at timestamp_ntz, completed_at timestamp_ntz, failure_reason string, result string"


def state(spark, rows):
    old = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 0, s, n, 3, p, old, None, w, parent, None, None, None, None) for i, s, n, p, w, parent in rows], STATE)


def by_id(frame):
    return {r["job_id"]: r for r in frame.collect()}


def test_claim_takes_the_highest_priority(spark):
    got = by_id(jobs.claimed(state(spark, [(1, "pending", 0, 0, None, None), (2, "pending", 1, 10, None, None), (3, "complete", 1, 99, None, None)]), now(), 1, ["queue"], F.lit("w")))
    assert [(got[i]["status"], got[i]["attempts"], got[i]["worker_id"]) for i in (1, 2, 3)] == [("pending", 0, None), ("claimed", 2, "w"), ("complete", 1, None)]


def test_completion_fills_the_inbox(spark):
    rows = state(spark, [(1, "claimed", 1, 0, "w", None), (2, "claimed", 1, 0, "w", 1), (3, "pending", 1, 0, None, 1)])
    after, inbox = jobs.complete(rows, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "job_id long, result string"), now())
    got = by_id(after)
    assert [(got[i]["status"], got[i]["result"]) for i in (1, 2, 3)] == [("complete", "a"), ("complete", "b"), ("pending", None)]
    assert [(r["parent_id"], r["child_id"], r["result"]) for r in inbox.collect()] == [(1, 2, "b")]


def test_failures(spark):
    rows = state(spark, [(1, "claimed", 2, 0, "w", None), (2, "claimed", 3, 0, "w", None), (3, "claimed", 1, 0, "w", None), (4, "pending", 1, 0, None, None)])
    asked = spark.createDataFrame([(1, "x" * 900, True), (2, "y", True), (3, "z", False), (4, "q", True)], "job_id long, reason string, retriable boolean")
    got = by_id(jobs.fail(rows, asked, now()))
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["pending", "dead", "failed", "pending"]
    assert got[1]["scheduled_at"] == dt.datetime(2024, 2, 1, 0, 0, 10) and got[1]["worker_id"] is None and len(got[1]["failure_reason"]) == 500
    assert got[4]["failure_reason"] is None and got[2]["failed_at"] == dt.datetime(2024, 2, 1)


def test_cancelling_goes_down_the_tree(spark):
    rows = state(spark, [(1, "claimed", 1, 0, "w", None), (2, "pending", 0, 0, None, 1), (3, "complete", 0, 0, None, 1), (4, "pending", 0, 0, None, 3), (5, "pending", 0, 0, None, None)])
    asked = spark.createDataFrame([(1,)], "job_id long")
    assert [by_id(jobs.cancel(rows, asked, now()))[i]["status"] for i in range(1, 6)] == ["cancelled", "cancelled", "complete", "cancelled", "pending"]
    assert [by_id(jobs.cancel(rows, asked, now(), cascade=False))[i]["status"] for i in range(1, 6)] == ["cancelled", "pending", "complete", "pending", "pending"]


def test_leases_are_renewed_by_their_holders(spark):
    rows = state(spark, [(1, "claimed", 1, 0, "a", None), (2, "claimed", 1, 0, "b", None), (3, "pending", 1, 0, "a", None)])
    got = by_id(jobs.renew(rows, spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "job_id long, worker_id string"), now()))
    assert [got[i]["claimed_at"] is not None for i in (1, 2, 3)] == [True, False, False]


def test_log_lines(spark):
    line = jobs.log_lines(spark.createDataFrame([(1, "warn", "m" * 3000)], "job_id long, level string, message string"), now()).first()
    assert line["level"] == "WARN" and len(line["message"]) == 2000


@pytest.mark.parametrize("links", [[], [(1, None)], [(i, i - 1 if i else None) for i in range(70)], [(1, 2), (2, 3), (3, 1), (4, 3), (5, 99), (6, 5), (7, 7)], [(i, i // 3 if i else None) for i in range(60)]])
def test_roots_of_trees(spark, links):
    parent, wanted = {i: p for i, p in links}, {}
    for i in parent:
        at, steps, seen = i, 0, set()
        while at not in seen and parent[at] in parent:
            seen.add(at)
            at, steps = parent[at], steps + 1
        wanted[i] = (None, None) if at in seen else (at, steps)
    found = trees.rooted(spark.createDataFrame(links, "id long, parent long")).collect()
    assert {r["id"]: (r["root"], r["depth"]) for r in found} == wanted


def test_requests_without_a_key_do_not_meet_in_one_task(spark):
    from stratamem.operators import jobs as J

    rows = spark.range(8000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("parent_id")).repartition(4)
    others = spark.range(0, 8000, 2).select(F.col("id").alias("_p"), F.lit(1).alias("_depth"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = J._met(rows, ["parent_id"], (others, F.col("parent_id") == F.col("_p")))
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8000 and max(sizes) <= 2500
        assert met.where("_p is not null").count() == 80 and met.where("_p = id and _depth = 1").count() == 80
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
