from __future__ import annotations

import hashlib
from collections import defaultdict

import __spark_entry__ as entry
from stratamem.llm import exact_dedup, stages
from tests.compare import assert_same, database
from tests.llm import cases

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_query_matches_sql(spark):
    sql = entry.oracle_sql()["op4_exact_dedup"]
    assert_same(entry.queries()["op4_exact_dedup"](spark, SF).toPandas(), database(SF).execute(sql).df())


def test_edge_cases_match_brute_force(spark):
    groups = defaultdict(list)
    for r in cases.rows():
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    wanted = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        wanted += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.assign_groups(cases.docs(spark)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_only_ascii_letters_are_lowered(spark):
    frame = spark.createDataFrame([(1, "É a"), (2, "é a"), (3, "É A")], "doc_id long, text string")
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup.assign_groups(frame).collect()}
    assert kept == {1: 3, 2: 2, 3: 3}


def test_one_text_in_all_rows(spark):
    frame = spark.range(3000).selectExpr("id as doc_id", "'same' as text")
    found = exact_dedup.assign_groups(frame)
    assert found.where("kept").count() == 1
    assert found.selectExpr("min(group_size) a", "max(keep_id) b").first() == (3000, 2999)


def test_kept_rows_have_all_columns(spark):
    source = cases.docs(spark)
    kept = exact_dedup.keep_rows(source)
    assert kept.columns == source.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [3, 4, 7, 8, 9, 10, 11, 12, 13, 13, 14, 15, 16]


def test_empty_table(spark):
    assert exact_dedup.assign_groups(cases.empty(spark)).count() == 0
    assert exact_dedup.keep_rows(cases.empty(spark)).count() == 0


def test_pipeline_keeps_one_row_of_each_text(spark):
    rows = [(1, "A", "x"), (1, "a", "y"), (1, "a", "y"), (2, "b", "x"), (3, "b", "x"), (2, "c", "x"), (None, "c", "x")]
    rows += [(None, "d", "x"), (None, "D", "x"), (None, "e", "x"), (None, "", "x"), (None, None, "x"), (4, "f", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = stages.drop_copies(spark, frame, SF)
    assert found.columns == frame.columns
    got = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (3, "b"), (2, "c"), (None, "d"), (None, "e"), (None, ""), (4, "f")], key=str)


def test_an_id_kept_for_another_text_keeps_no_copy(spark):
    frame = spark.createDataFrame([(2, "b"), (3, "b"), (2, "c")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.keep_rows(frame).collect())) == [(2, "c"), (3, "b")]
