"""One hour of idempotency against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

from stratamem.operators.idempotency import first_accepted
from stratamem.streaming import queries as Q

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id long, at timestamp"


def plain(rows):
    last, kept = {}, []
    for key, i, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if key is None or key not in last or at - last[key] > dt.timedelta(hours=1):
            last[key] = at
            kept.append((key, i))
    return sorted(kept, key=str)


def some_rows(seed: int):
    rng = random.Random(seed)
    rows = [("forty", n, START + dt.timedelta(minutes=40 * n)) for n in range(50)]
    rows += [("hour", 100 + n, START + dt.timedelta(hours=n)) for n in range(20)]  # an hour to the second is not over an hour
    rows += [("hot", 1000 + n, START + dt.timedelta(seconds=rng.randrange(200_000))) for n in range(3000)]
    rows += [("same", 9000 + n, START) for n in range(30)]
    return rows


def test_batch(spark):
    rows = [*some_rows(1), (None, 1, START), (None, 2, START), ("never", 3, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(((r["key"], r["id"]) for r in first_accepted(frame).collect()), key=str) == plain(rows)
    assert [i for k, i in plain(rows) if k == "forty"][:3] == [0, 10, 12] and first_accepted(frame.limit(0)).count() == 0


def test_stream_over_batches(spark):
    rows = some_rows(2)
    found = Q.run_available(Q.accepted_of_key(Q.in_slices(spark.createDataFrame(rows, SCHEMA), "at", 3), 3600, "10 minutes"), "append")
    assert sorted(((r["key"], r["id"]) for r in found.collect()), key=str) == plain(rows)
