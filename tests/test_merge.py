from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from stratamem.operators import vector


@pytest.mark.parametrize("block", [3, 1024])
def test_greedy_merge_takes_all_neighbours_of_a_label(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.0, 0.0], i % 2) for i in range(40)]
    rows += [(100 + i, [float(x) for x in rng.normal(size=4)], 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    wanted = {}
    for n, (i, a, g) in enumerate(rows):
        for j, b, h in rows[n + 1 :] if i not in wanted else []:
            cos = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
            if g == h and j not in wanted and (1 + cos) / 2 >= 0.6:
                wanted[j] = i
    found = entry.queries()["semantic_greedy_merge"](spark, f"file://{tmp_path}").collect()
    assert {r["uuid"]: r["merged_into"] for r in found} == wanted and len(found) == len(wanted)
