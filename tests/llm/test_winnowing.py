from __future__ import annotations

import hashlib

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.llm import winnowing as W
from stratamem.sources.tables import table
from tests.llm import cases


def prints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["prints"] for r in W.fingerprints(frame).collect()}


def test_windows_keep_the_rightmost_least(spark):
    values = [5, 3, 3, 9, 8, 7, 6, 5, 4, 4, 9, 1, 2, 2, 2, 2, 2, 2, 2, 2]
    frame = spark.createDataFrame([(values,)], "g array<bigint>")
    got = frame.select(W.winnow(F.col("g")).alias("x")).first()["x"]
    hashed = {v: frame.select(F.shiftrightunsigned(F.xxhash64(F.lit(v).cast("bigint")), 33).alias("h")).first()["h"] for v in set(values)}
    h = [hashed[v] for v in values]
    wanted = {max((-h[j], j) for j in range(i, i + W.WINDOW))[1] for i in range(len(h) - W.WINDOW + 1)}
    assert {(1 << 32) - 1 - (x & (1 << 32) - 1) for x in got} == wanted


def test_rolling_hash_is_the_polynomial(spark):
    words = cases.text(3, 40).split()
    frame = spark.createDataFrame([(words,)], "t array<string>")
    got = frame.select(W.kgram_hashes(F.col("t")).alias("x")).first()["x"]
    codes = [r["c"] for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(F.pmod(F.xxhash64("w"), F.lit(W.PRIME)).alias("c")).collect()]
    wanted = []
    for i in range(len(codes) - W.K + 1):
        value = 0
        for c in codes[i : i + W.K]:
            value = (value * W.BASE + c) % W.PRIME
        wanted.append(value)
    assert got == wanted


def test_shared_runs_are_found(spark):
    shared = " ".join(cases.text(9, W.K + W.WINDOW - 1).split())
    found = prints(spark, [f"{cases.text(2, 50)} {shared} {cases.text(4, 30)}", f"start {shared} end of it", "a" * 90 + "漢字かな交じり文を書くことができる", "b" * 31 + "漢字かな交じり文を書くことができる"])
    hashes = {k: {x >> 32 for x in v} for k, v in found.items()}
    assert hashes[0] & hashes[1]
    assert hashes[2] & hashes[3]


def check(spark, frame, rows):
    found = {r["doc_id"]: r for r in frame.collect()}
    ids = sorted(rows)
    assert sorted(found) == ids
    for n, i in enumerate(ids):
        body, following = rows[i] or "", rows[ids[(n + 1) % len(ids)]] or ""
        tail = len(body) // 4
        changed = body[: len(body) - tail] + following[:tail]
        assert found[i]["n_chars"] == len(body)
        assert found[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    return found


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    found = check(spark, entry.queries()["op6_winnowing"](spark, d), rows)
    by_text = {}
    for i, r in found.items():
        assert by_text.setdefault(rows[i], r["fingerprint"]) == r["fingerprint"]
    likely = sorted(r["near_edited"] for r in found.values())
    assert likely[len(likely) // 2] > 0.5
    assert sum(r["near_next"] for r in found.values()) / len(found) < 0.05


def test_edge_cases(spark):
    frame = W.compare_with_edits(cases.docs(spark))
    assert frame.count() == len(cases.rows())
    assert all(r["near_next"] is not None for r in frame.collect())
    assert W.compare_with_edits(cases.empty(spark)).count() == 0
    distinct = {r[0]: r[1] for r in cases.rows() if r[0] is not None}
    one = cases.docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check(spark, W.compare_with_edits(one), distinct)


@pytest.mark.parametrize("fan", [1024, 4, 2])
def test_many_ranges(spark, monkeypatch, fan):
    monkeypatch.setattr(W, "RANGE_ROWS", 3)
    monkeypatch.setattr(W, "FAN", fan)
    rows = {i * 7: cases.text(i % 11, 30) for i in range(50)}
    check(spark, W.compare_with_edits(spark.createDataFrame(list(rows.items()), "doc_id long, text string")), rows)
    lone = spark.createDataFrame([(1, cases.text(3))], "doc_id long, text string")
    assert W.compare_with_edits(lone).first()["near_next"] == 1.0


def slow_prints(text):
    """Winnowing, plainly: tokens, polynomial hashes, the rightmost least hash of each window."""
    single = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"
    letter = rf"(?:(?!{single})[\p{{L}}\p{{M}}\p{{N}}])"
    tokens = [m[0] for m in regex.finditer(rf"{letter}{{1,24}}+(?!{letter})|\S", text.lower())]
    codes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    codes = [(c - (1 << 64) if c >> 63 else c) % W.PRIME for c in codes]
    grams = []
    for i in range(max(1, len(codes) - W.K + 1) if codes else 0):
        value = 0
        for c in codes[i : i + W.K]:
            value = (value * W.BASE + c) % W.PRIME
        grams.append(xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42) >> 33)
    places = set()
    for i in range(max(1, len(grams) - W.WINDOW + 1) if grams else 0):
        window = list(enumerate(grams[i : i + W.WINDOW], i))
        places.add(min(window, key=lambda x: (x[1], -x[0]))[0])
    return [(grams[i], i) for i in sorted(places)]


def near(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, d, "documents").collect()}
    found = {r["doc_id"]: r for r in entry.queries()["op6_winnowing"](spark, d).collect()}
    ids = sorted(rows)
    for n, i in enumerate(ids):
        body, following = rows[i], rows[ids[(n + 1) % len(ids)]]
        tail = len(body) // 4
        own, changed, ahead = map(slow_prints, (body, body[: len(body) - tail] + following[:tail], following))
        assert found[i]["fingerprint"] == ",".join(f"{h:x}:{k}" for h, k in own)
        assert found[i]["edited_fingerprint"] == ",".join(f"{h:x}:{k}" for h, k in changed)
        assert abs(found[i]["near_edited"] - near(own, changed)) < 1e-12
        assert abs(found[i]["near_next"] - near(own, ahead)) < 1e-12


def test_rows_of_one_id_have_a_next_each(spark):
    rows = [(1, cases.text(3)), (1, cases.text(4)), (1, cases.text(4)), (2, cases.text(5))]
    found = W.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 1, 1, 2]
    assert len({r["edited_sha256"] for r in found}) == 4
