from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from stratamem.llm import jaccard_join, mixing
from stratamem.sources.tables import table
from tests.llm import cases
from tests.llm.test_repeats import brute_links
from tests.llm.test_tokens import WORDS, whole

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        path = f"file://{tmp_path_factory.mktemp('pipeline')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]


def test_columns_are_kept(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(stages[n].columns == columns for n, _ in P.STAGES[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {r["doc_id"] for r in stages["toxicity"].collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    toxic, clean = [i for i, t in labels.items() if t], [i for i, t in labels.items() if not t]
    assert sum(i not in kept for i in toxic) >= 0.6 * len(toxic)
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_one_document_of_each_text(stages):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    top = {}
    for r in stages["toxicity"].collect():
        key = r["text"].translate(lower)
        top[key] = max(top.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages["exact_dedup"].collect()) == sorted(top.values())


def test_one_document_of_each_class(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect())
    classes = brute_links([t for _, t in rows])
    wanted = sorted({rows[c][0] for c, _ in classes})
    assert sorted(r["doc_id"] for r in stages["jaccard_join"].collect()) == wanted


def test_mix_repeats_documents(spark, stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages["jaccard_join"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in stages["mixing"].collect()) == copies


def test_packing_holds_every_copy(stages):
    mixed, rows = stages["mixing"].collect(), stages["packing"].collect()
    assert sum(r["length"] for r in rows) == sum(len(whole(WORDS, r["text"])) + 1 for r in mixed)
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) / 4096 * 1.02 + 1


def test_run_gives_the_last_stages_rows(spark, stages):
    found = entry.queries()["pipeline"](spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(map(tuple, stages["packing"].select(*columns).collect()))


def test_awkward_documents(spark, tmp_path):
    cases.docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() > 0
    assert jaccard_join.near_duplicates(spark.read.parquet(f"file://{tmp_path}/documents.parquet")).count() == len(cases.rows())


def test_empty_documents(spark, tmp_path):
    cases.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
