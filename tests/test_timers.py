"""Queue timers over several micro-batches and a restart, against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stratamem.streaming import leases

SCHEMA = "event_id long, job_id long, kind string, at timestamp, worker_id string, timeout_seconds int, max_attempts int"
START = dt.datetime(2024, 1, 1)


def some_events(seed: int, jobs: int, n: int):
    rng, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 60])
        rows.append((i, rng.randrange(jobs), rng.choice(["claim", "claim", "renew", "renew", "complete", "fail"]), at, rng.choice("ab"), rng.choice([10, 60]), 4))
    return rows


def plain(rows, delay):
    """What fires, event by event; what no event follows fires if the last watermark has passed it."""
    passed = max(r[3] for r in rows) - delay
    fired, state = [], {}
    for _, job, kind, at, who, timeout, most in rows:
        s = state.setdefault(job, {"phase": None, "attempts": 0})
        if s["phase"] and at > s["ends"]:
            fired.append((job, "expired" if s["phase"] == "held" else "due", s["ends"], s["attempts"]))
            s["phase"] = None
        if kind == "claim":
            s.update(phase="held", who=who, lasts=2 * timeout, ends=at + 2 * timeout, attempts=s["attempts"] + 1)
        elif s["phase"] == "held" and who == s["who"]:
            if kind == "renew":
                s["ends"] = at + s["lasts"]
            elif kind == "fail" and s["attempts"] < most:
                s.update(phase="waiting", ends=at + min(3600, 5 * 2 ** max(0, s["attempts"] - 1)))
            else:
                s["phase"] = None
    for job, s in state.items():
        if s["phase"] and s["ends"] <= passed:
            fired.append((job, "expired" if s["phase"] == "held" else "due", s["ends"], s["attempts"]))
    return sorted(fired)


def write(spark, rows, path):
    found = [(a, b, c, START + dt.timedelta(seconds=t), *more) for a, b, c, t, *more in rows]
    spark.createDataFrame(found, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, root):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = leases.queue_timers(stream, "30 seconds").writeStream.format("parquet").option("path", f"{root}/out")
    query = out.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


@pytest.mark.parametrize("cuts", [(1, [0, 400]), (2, [0, 100, 200, 300, 400]), (3, [0, 7, 399, 400])])
def test_each_timer_fires_once(spark, tmp_path, cuts):
    seed, places = cuts
    rows = some_events(seed, 6, 400)
    half = max(1, len(places) // 2)
    batches = 0
    for some in (places[: half + 1], places[half:]):  # the second run starts from what the first has left
        parts = list(zip(some, some[1:], strict=False))
        for i, j in parts:
            write(spark, rows[i:j], f"{tmp_path}/in")
        batches += run(spark, tmp_path) if parts else 0
    assert batches == len(places) - 1
    fired = sorted((r["job_id"], r["event"], (r["at"] - START).total_seconds(), r["attempts"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert fired == plain(rows, 30)


def test_no_events(spark, tmp_path):
    write(spark, [], f"{tmp_path}/in")
    run(spark, tmp_path)
    assert spark.read.schema(leases.EVENTS).parquet(f"{tmp_path}/out").count() == 0


def test_jobs_share_calls_to_the_state_store(spark, tmp_path):
    rows = [(i, None if i % 50 == 0 else 2**60 + i % 50, "claim", 0, "a", 10, 4) for i in range(100)] + [(100, 2**60 + 1, "renew", 5, "a", 10, 4), (101, 2**60 + 2, "claim", 500, "b", 10, 4)]
    write(spark, rows, f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = leases.queue_timers(stream, "30 seconds", buckets=2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(leases.EVENTS).parquet(f"{tmp_path}/out").collect()
    got = sorted(((r["job_id"] or 0, r["event"], (r["at"] - START).total_seconds(), r["attempts"]) for r in found))
    # the job that was claimed again has its old lease run out first, and its new one still open
    assert got == sorted([(0 if n == 0 else 2**60 + n, "expired", 25 if n == 1 else 20, 2) for n in range(50)])
    # three buckets, that of the missing job included: a timer each, not one for each of fifty jobs
    assert max(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in query.recentProgress if p.stateOperators) <= 3
