from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from stratamem.llm import packing, token_count
from stratamem.llm.segments import load
from stratamem.sources.tables import table
from tests.llm import cases

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [" ", "\n", "a", "b", "é", "œ", "'", "s", "t", "1", ".", "<|endoftext|>", "\t", "́", "Z", "!", "  ", "中", "\xa0", "²", "İ"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)


def whole(path: str, text: str) -> list[int]:
    return load(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_are_the_librarys(text):
    assert token_count.count_batch(BYTES, [text]) == [len(whole(BYTES, text))]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(packing.ids_batch(WORDS, [text])[0], "<u4").tolist() == whole(WORDS, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, " " * 70, "x" * 70]), min_size=30, max_size=200).map("".join))
def test_spliced_chunks_are_the_librarys(text):
    assert token_count.count_spliced(load(BYTES), text, chunk=50, overlap=4) == len(whole(BYTES, text))


def test_huge_text_is_spliced(monkeypatch):
    text = cases.text(3, 30_000)
    assert len(text) > 3 * token_count.CHUNK
    assert token_count.count_batch(BYTES, [text]) == [len(whole(BYTES, text))]


def test_count_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    for r in entry.queries()["op7_token_counts"](spark, d).collect():
        n = len(whole(BYTES, texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 512)


def test_count_edge_cases(spark):
    found = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_count.count_tokens(cases.docs(spark), BYTES).collect())
    assert found == sorted((str(r[0]), len(whole(BYTES, r[1] or ""))) for r in cases.rows())
    assert token_count.count_tokens(cases.empty(spark), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_whole_and_tight(seed):
    rng = random.Random(seed)
    lengths = [min(4095, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)]
    found = packing.pack_lengths(lengths)
    assert sorted(k for s in found for k in s) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in s) <= 4096 for s in found)
    assert len(found) <= -(-sum(lengths) // 4096) * 1.01 + 1


def test_two_documents_replace_the_smallest():
    # greedy takes 5, 3 and leaves 2; 3 gives way to 3 + 2 of the rest, which fill the gap
    found = packing.pack_lengths([5, 4, 3, 1], capacity=10)
    assert [sorted([5, 4, 3, 1][k] for k in s) for s in found] == [[1, 4, 5], [3]]
    found = packing.pack_lengths([6, 3, 2, 2], capacity=10)
    assert [sorted([6, 3, 2, 2][k] for k in s) for s in found] == [[2, 2, 6], [3]]


def check_packed(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, found in by_doc.items():
        ids = [*whole(WORDS, texts[doc_id] or ""), 1]
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids) // 4096)))
        for r in found:
            part = ids[r["start"] : r["start"] + 4096]
            assert (r["start"], r["length"]) == (r["piece"] * 4096, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_sequence), sum(r["length"] for r in rows)


def test_pack_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    sequences, tokens = check_packed(entry.queries()["op8_best_two_fit"](spark, d).collect(), texts)
    assert sequences <= tokens / 4096 * 1.02 + 1


def test_pack_edge_cases(spark):
    found = packing.pack(cases.docs(spark), WORDS).collect()
    tokens = sum(len(whole(WORDS, r[1] or "")) + 1 for r in cases.rows())
    assert sum(r["length"] for r in found) == tokens
    assert all(len(r["ids"]) == 4 * r["length"] for r in found)
    assert sum(r["doc_id"] == 13 for r in found) == 2
    assert packing.pack(cases.empty(spark), WORDS).count() == 0


def test_full_pieces_and_leftovers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 5)
    from stratamem.llm.op_queries import packed_digests

    frame = cases.docs(spark).where("doc_id is not null and doc_id <> 13")
    check_packed(packed_digests(frame).collect(), {r[0]: r[1] for r in cases.rows() if r[0] not in (None, 13)})
