"""Suffix-array dedup and the Jaccard join, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from stratamem.llm import components, jaccard_join, stages, suffix_dedup
from stratamem.sources.tables import table
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def without_repeats(texts, length=400):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone) if not x)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_suffix_query(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in entry.queries()["op10_suffix_dedup"](spark, SF).collect()}
    wanted = without_repeats([(r["text"] or "").encode() for r in docs])
    assert [found[r["doc_id"]] for r in docs] == wanted
    assert sum(w[1] for w in wanted) > 0


@pytest.mark.parametrize("hot", [1024, 2])
def test_hard_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 500)
    rng = random.Random(hot)

    def some(n, letters="abcdé "):
        return "".join(rng.choices(letters, k=n))

    shared, edge = some(900), some(390)
    texts = ["", "short", "z" * 1500, "ab" * 700, edge, edge + "!", some(10_000), shared, some(300) + shared[:500] + some(200), some(77) + shared[300:] + some(5)]
    texts += [some(rng.randint(0, 300)) + shared[a : a + 450] + some(rng.randint(0, 300)) for a in range(0, 450, 50)]
    texts += [texts[6][2000:2600] + some(50), texts[6][4700:5300]] + ["".join(rng.choices([shared[:200], shared[200:390], edge, "x"], k=6)) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame).collect()}
    got = [(found[i]["n_bytes"], sum(s["end"] - s["start"] for s in found[i]["spans"]), len(found[i]["spans"]), hashlib.sha256(bytes(found[i]["kept"])).hexdigest()) for i in range(len(texts))]
    assert got == without_repeats([t.encode() for t in texts])


def test_suffix_array_is_sorted():
    rng = random.Random(0)
    data = bytes(rng.choices(b"ab", k=2000)) * 2
    order, rank = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), 256)
    keys = [data[i : i + 256].ljust(256, b"\0") for i in order]
    assert keys == sorted(keys)
    assert all((keys[i] == keys[i + 1]) == (rank[order[i]] == rank[order[i + 1]]) for i in range(len(keys) - 300))
    lcp = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), order, np.full(len(order) - 1, 1), 400)
    for i in range(1, 200):
        a, b = data[order[i] :], data[order[i - 1] :]
        n = next((k for k in range(min(len(a), len(b), 400)) if a[k] != b[k]), min(len(a), len(b), 400))
        assert lcp[i] == (n if n else lcp[i])


def test_suffix_edge_cases(spark):
    found = suffix_dedup.remove_repeats(cases.docs(spark)).collect()
    order = sorted(cases.rows(), key=lambda r: (str(r[0]), r[1] or ""))
    wanted = without_repeats([(r[1] or "").encode() for r in order])
    got = [(r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found]
    assert sorted(got) == sorted(wanted)
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(find(i), links[i]) for i in range(len(sets))]


def variants(n, rng):
    base = cases.text(6, 200).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    docs = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    texts = docs + variants(60, rng) + variants(1, rng) * 5 + ["one two", "One, two!", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(frame).collect()}
    assert [found[i] for i in range(len(texts))] == brute_links(texts)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = random.Random(3)
    kept = 0
    for trial in range(200):
        words = [f"w{trial}x{i}" for i in range(400)]
        other = list(words)
        for k in rng.sample(range(10, 390, 12), 8):
            other[k] = "changed"
        a, b = jaccard_join.shingles(" ".join(words)), jaccard_join.shingles(" ".join(other))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        signatures = np.array([jaccard_join.signature(a), jaccard_join.signature(b)])
        kept += len(jaccard_join.prune(signatures, np.array([0]), np.array([1])))
    assert kept == 200
    apart = np.array([jaccard_join.signature(jaccard_join.shingles(cases.text(n, 300))) for n in (2, 9)])
    assert len(jaccard_join.prune(apart, np.array([0]), np.array([1]))) == 0


def test_verification_by_matrix_is_exact():
    rng = random.Random(1)
    sets = [jaccard_join.shingles(t) for t in variants(40, rng)]
    left, right = np.triu_indices(40, 1)
    assert len(left) > 8 * 40
    few = [jaccard_join.verified(sets, left[k : k + 1], right[k : k + 1])[0] for k in range(len(left))]
    assert jaccard_join.verified(sets, left, right).tolist() == few


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert {found[i] for i in range(31)} == {0} and {found[i] for i in range(31, 61)} == {31} and found[100] == 100


def test_join_edge_cases(spark):
    rows = jaccard_join.near_duplicates(cases.docs(spark)).collect()
    assert len(rows) == len(cases.rows())
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None}
    assert got[1] == (1, 0) and got[2] == (2, 0) and got[11] == (11, 0)
    assert got[5][0] == got[6][0] == got[7][0] == got[8][0] == 5 and got[5][1] == 3
    assert got[13] == (13, 1)
    assert all(r["class_id"] is None and r["n_links"] == 0 for r in rows if r["doc_id"] is None)
    assert jaccard_join.near_duplicates(cases.empty(spark)).count() == 0
    source = cases.docs(spark)
    kept = jaccard_join.keep_one(source)
    assert kept.columns == source.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "9", "10", "11", "12", "13", "13", "14", "15", "16", "None", "None"])


def test_pipeline_keeps_one_row_of_each_class(spark):
    near = cases.text(5).split()
    near[60] = "changed"
    near, other = " ".join(near), cases.text(8)
    rows = [(5, cases.text(5)), (13, near), (13, other), (13, other), (None, cases.text(5)), (None, cases.text(11)), (None, cases.text(11)), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = stages.drop_near_copies(spark, frame, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, cases.text(5)), (13, other), (None, cases.text(11)), (None, "")], key=str)


def test_components_of_random_links(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(0, n) for n in range(500, 700)]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for pair in pairs for x in pair}


def test_links_among_hubs_follow_the_texts(spark):
    rng = random.Random(4)
    met = [(text, rng.randrange(0, 20)) for text in range(100, 300) for _ in range(42)]
    links = jaccard_join._hub_links(spark.createDataFrame(met, "rep long, hub long"))
    assert links.count() <= 200 + 20 * 20
    assert set(components.components(links).select("component").distinct().toPandas()["component"]) == {0}


def test_keep_one_knows_an_id_by_its_text(spark):
    a, b = cases.text(5), cases.text(8)
    kept = jaccard_join.keep_one(spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (5, b)]


def shared_passages(texts, length=51):
    """Maximal runs of words covered by runs of ``length`` words that another document has too."""
    holders = defaultdict(set)
    words = [re.findall(rb"[^\x00-\x20]+", (t or "").encode()) for t in texts]
    for k, w in enumerate(words):
        for i in range(len(w) - length + 1):
            holders[tuple(w[i : i + length])].add(k)
    out = []
    for w in words:
        covered = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if len(holders[tuple(w[i : i + length])]) > 1:
                covered[i : i + length] = b"\1" * length
        out.append([m.span() for m in re.finditer(b"\1+", bytes(covered))])
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_shared_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 500)
    rng = random.Random(hot)

    def some(n):
        return [f"{rng.choice('abcdefgé')}{rng.randrange(60)}" for _ in range(n)]

    passage, short = some(51), some(50)
    texts = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    texts += [" ".join(some(rng.randint(0, 90)) + passage + some(rng.randint(0, 90))) for _ in range(12)]
    texts += [" ".join(some(30) + short + some(30)) for _ in range(3)]
    twice = some(70)
    texts += [" ".join(twice + some(9) + twice), " ".join(some(5) + twice[10:65] + passage[:20]), "\t".join(passage) + "\n", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["passages"]] for r in suffix_dedup.remove_repeats(frame).collect()}
    wanted = shared_passages(texts)
    assert [found[i] for i in range(len(texts))] == wanted
    assert sum(map(len, wanted)) > 20
