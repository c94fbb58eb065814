"""Cross-tokenizer alignment against whole texts through both libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from stratamem.llm import cross_align as C
from stratamem.sources.tables import table
from tests.llm import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ALPHABET = [" ", "\n", "\t", "\r", "a", "b", "é", "'s", "1", ".", "<|endoftext|>", "<s>", "</s>", "\xa0", "中", "🙂", "　", "  ", "the", " the", "\x1c", "\x85", ";\r", "\x00", "ﬁ", "é", " "]


def whole(text):
    """Ids of both for a text, by the libraries."""
    return C.load_a(A)[0].encode(f" {text}", add_special_tokens=False).ids, C.load_b(B)[0].encode(text)


def plain(texts):
    """Rows by brute force: all pairs of tokens whose byte ranges overlap."""
    bytes_a, bytes_b = C.load_a(A)[1], C.load_b(B)[1]
    found, counts = [], Counter()
    for text in texts:
        a, b = whole(text) if text else ([], [])
        joined = [b"".join(n[x] for x in ids) for ids, n in ((a, bytes_a), (b, bytes_b))]
        if not text or any(x != f" {text}".encode() for x in joined):
            found.append(None)
            continue
        spans = []
        for ids, names in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(names[x]), x))
                at = out[-1][1]
            spans.append(out)
        links, low = [], 0
        for s, e, x in spans[0]:
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= cut:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                gb.append(b[j])
                j += 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if f is None
        else (*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest())
        for f in found
    ]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=40).map("".join))
def test_segments_are_the_whole_text(text):
    segments = C.cutter(C.safe_cuts(A, B)).findall(f" {text}")
    assert "".join(segments) == f" {text}"
    a, b = whole(text)
    assert [x for s in C.encode_a(A, segments) for x in s] == a
    assert [x for s in C.encode_b(B, segments) for x in s] == b


def test_all_characters_but_one_keep_their_bytes():
    pieces, names = C.load_b(B)
    for n in [*range(0xD800), *range(0xE000, 0x110000)]:
        if chr(n) != C.SIGN:
            assert b"".join(names[x] for x in pieces.encode(chr(n))) == f" {chr(n)}".encode()


def test_cuts_are_those_the_vocabularies_allow():
    assert C.safe_cuts(A, B) == " \n\t"
    assert C.cutter(" \n\t").findall(" a b\r c\r\nd \n e") == [" a", " b\r c\r\nd", " \n e"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = table(spark, d, "documents").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in docs), plain([r["text"] for r in docs]), strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in entry.queries()["op11_cross_align"](spark, d).collect()}
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_edge_cases(spark, monkeypatch, small):
    if small:  # many blocks and tasks, and pairs joined by shuffle
        monkeypatch.setattr(C, "BLOCK_CHARS", 300)
        monkeypatch.setattr(C, "SHARE", 100)
        monkeypatch.setattr(C, "FEW_PAIRS", 0)
        monkeypatch.setattr(C, "OUT_CHARS", 10)
    frame, rows = cases.docs(spark), [(r[0], r[1]) for r in cases.rows()]
    more = [(90, f"with {C.SIGN} sign"), (91, " "), (92, "\n"), (93, "a "), (94, "\t x\r\n y"), (95, "<|endoftext|> </s>")]
    frame = frame.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows += more
    got = [(r["doc_id"], *(r[c] for c in COLUMNS[:-1]), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in C.align_tokenizers(frame, A, B).collect()]
    assert sorted(got, key=str) == sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]), strict=True)), key=str)
    assert C.align_tokenizers(cases.empty(spark), A, B).count() == 0
