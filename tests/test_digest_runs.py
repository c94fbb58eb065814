"""Two runs of the digest leave what one over both windows does."""

from __future__ import annotations

import datetime as dt

import numpy as np

from stratamem.operators import compaction

SCHEMA = "group long, uuid long, content string, vector array<double>, created_at timestamp"


def some_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(160):
        vector = None if i % 17 == 0 else (centres[i % 6] + 0.25 * rng.normal(size=5)).tolist()
        rows.append((i % 3, i, f"text {i % 48}" if i % 4 == 0 else f"own {i}", vector, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)))
    return rows



def test_two_runs_are_as_one(spark, tmp_path):
    rows = some_rows()
    one, two = (compaction.digest_store(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    compaction.digest_batch(one, spark.createDataFrame(rows, SCHEMA), 0)
    compaction.digest_batch(two, spark.createDataFrame(rows[:90], SCHEMA), 0)
    compaction.digest_batch(two, spark.createDataFrame(rows[90:], SCHEMA), 1)
    compaction.digest_batch(two, spark.createDataFrame(rows[90:], SCHEMA), 1)  # run again
    got, want = ([(u, m, s) for u, m, s in sorted(((u, m if m is not None else -1, s or "") for u, m, s in x))] for x in (_raw(two), _raw(one)))
    assert got == want and len(got) == 160
    assert {s for _, _, s in got} == {"", "exact", "semantic"}
    # what was merged away is in no table that a later run reads
    merged = {u for u, m, _ in got if m != -1}
    assert not merged & {r["uuid"] for t in ("contents", "keepers") for r in two.read(t).collect()} - {u for u, _, s in got if s == "semantic"}
    assert not merged & {r["uuid"] for r in two.read("keepers").collect()}


def _raw(store):
    return [(r["uuid"], r["merged_into"], r["step"]) for r in store.read("markers").collect()]
