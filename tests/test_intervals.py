"""Intervals that hold at anchors, against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratamem.operators import temporal

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("unit", [60, 3600])
def test_holding(spark, unit):
    rng = random.Random(unit)
    time = lambda: START + dt.timedelta(seconds=rng.randrange(-50_000, 500_000))
    rows = []
    for i in range(300):
        a, b = sorted((time(), time()))
        rows.append((i, a, rng.choice([None, a, b, b])))
    anchors = [(n, rng.choice([r[1] for r in rows] + [time() for _ in range(50)])) for n in range(60)]
    found = temporal.holding(spark.createDataFrame([*rows, (999, None, None)], "id int, start timestamp, end timestamp"), spark.createDataFrame(anchors, "n int, at timestamp"), unit)
    got = [(r["id"], r["n"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, n) for i, a, b in rows for n, t in anchors if a <= t and (b is None or b >= t)}


def test_an_interval_is_few_rows(spark):
    one = spark.createDataFrame([(1, START + dt.timedelta(hours=1), START + dt.timedelta(days=4000))], "id int, start timestamp, end timestamp")
    anchors = spark.range(5000).select((F.lit(START) + F.make_dt_interval(days=F.col("id").cast("int"))).alias("at"))
    found = temporal.holding(one, anchors, 86400)
    assert found.count() == 4000 and temporal.holding(one, anchors.limit(0)).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
