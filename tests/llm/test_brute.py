"""Whole queries against slow, plain versions of their methods."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.llm import language_id, mixing, op_queries, packing, toxicity
from stratamem.sources.tables import table

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """Spark's xxhash64 of longs and, given as (value,), ints."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


# --- Mixing ---------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight; what is above a cap is reshared among the others until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return {**full, **{s: left * weight[s] / total for s in rest}}
        for s in over:
            full[s] = float(cap * sizes[s])
            left -= full[s]


def fold(items, seed, level):
    """Pivotal rounding of one block, in order of size."""
    current, done = None, []
    for x in sorted(items, key=lambda x: (-x[2], spark_hash(x[0], (seed,)), x[0])):
        if current is None:
            current = x
            continue
        (ia, oa, sa, pa), (ib, ob, sb, pb) = current, x
        up, down = min(sa * (1 - pa), sb * pb), min(sa * pa, sb * (1 - pb))
        u = ((spark_hash(ia, ib, (seed,), (level,)) & (1 << 64) - 1) >> 11) / float(1 << 53)
        if (u < down / (up + down)) if up + down > 0 else pa >= 0.5:
            if sa * (1 - pa) <= sb * pb:
                current, closed = (ib, ob, sb, pb - up / sb), (ia, 1)
            else:
                current, closed = (ia, oa, sa, pa + up / sa), (ib, 0)
        elif sa * pa <= sb * (1 - pb):
            current, closed = (ib, ob, sb, pb + down / sb), (ia, 0)
        else:
            current, closed = (ia, oa, sa, pa - down / sa), (ib, 1)
        done.append(closed)
    return current, done


def plain_mix(rows, seed=17):
    """{doc_id: copies} of (doc_id, text, source) with distinct ids."""
    sized = {i: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows}
    sizes = defaultdict(int)
    for n, s in sized.values():
        sizes[s] += n
    targets, copies = plain_targets(sizes), {}
    for source in sizes:
        ratio = targets[source] / sizes[source] if sizes[source] else 0.0
        part, left = ratio - math.floor(ratio), []
        for i, (n, s) in sized.items():
            if s == source:
                copies[i] = math.floor(ratio) if n else 0
                if n and part > 0:
                    left.append((i, n, n, part))
        level = 0
        while left:
            blocks, dealt = math.ceil(len(left) / mixing.BLOCK), defaultdict(list)
            for x in left:
                dealt[spark_hash(x[0], (seed,), (level,)) % blocks].append(x)
            left = []
            for block in dealt.values():
                current, done = fold(block, seed, level)
                for i, extra in done:
                    copies[i] += extra
                left.append(current)
            if blocks == 1:
                copies[left[0][0]] += left[0][3] >= 0.5
                break
            level += 1
    return copies


@pytest.mark.parametrize("block", [128, 5])
def test_mix_matches_plain_rounding(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    wanted = plain_mix(rows)
    found = op_queries.op1_mixing(spark, SF).collect()
    assert {r["doc_id"]: r["copies"] for r in found} == wanted
    assert len(set(wanted.values())) > 1


# --- Packing --------------------------------------------------------------------------------


def plain_pack(lengths, capacity):
    """Best-two-fit over a list, by trying everything."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        inside, gap = [], capacity
        for n in list(left):
            if n <= gap:
                inside.append(n)
                left.remove(n)
                gap -= n
        if gap and len(inside) > 1:
            small = inside[-1]
            room, best = gap + small, (small, None)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best[0] < a + b <= room:
                        best = (a + b, (a, b))
            if best[1]:
                inside.pop()
                for n in best[1]:
                    inside.append(n)
                    left.remove(n)
                left = sorted([*left, small], reverse=True)
        out.append(tuple(sorted(inside)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_packing_matches_trying_everything(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([20, 60, 99])) for _ in range(rng.randint(0, 90))]
    found = [tuple(sorted(lengths[k] for k in inside)) for inside in packing.pack_lengths(lengths, 100)]
    assert found == plain_pack(lengths, 100)


def test_pack_query_matches_plain_packing(spark):
    rows = op_queries.op8_best_two_fit(spark, SF).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append(r["length"])
    lengths = [r["length"] for r in rows if r["length"] < packing.CAPACITY]
    first = plain_pack(lengths, packing.CAPACITY)
    again = [n for x in first if sum(x) < int(packing.CAPACITY * packing.FULL) for n in x]
    wanted = [x for x in first if sum(x) >= int(packing.CAPACITY * packing.FULL)] + plain_pack(again, packing.CAPACITY)
    whole = sum(r["length"] == packing.CAPACITY for r in rows)
    assert len(found) == len(wanted) + whole
    assert sorted(map(sum, found.values())) == sorted([*map(sum, wanted), *[packing.CAPACITY] * whole])


# --- Toxicity -------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_find(word, terms):
    """The term of a word: itself, its shortest stem, or the least one within an edit behind the first letter."""
    if word in terms:
        return word, 0
    for n in range(1, len(word) + 1):
        if f"{word[:n]}*" in terms:
            return f"{word[:n]}*", 0
    near = {}
    for term in terms:
        base = term.rstrip("*")
        if len(base) >= toxicity.FUZZY and base[0] == word[0] and abs(len(base) - len(word)) < 2 and distance(base[1:], word[1:]) <= 1:
            near[base] = max(near.get(base, ""), term)  # a stem before the plain word
    return (min(near.values()), 1) if near else None


def plain_score(text, model):
    low = text.lower()
    found = list(toxicity.WORD.finditer(low))
    words, exact, fuzzy, seen = [m[0] for m in found], 0.0, 0.0, False
    for i, word in enumerate(words):
        hit = plain_find(word, model.lexicon)
        if hit is None:
            continue
        seen = True
        around = found[max(0, i - 4) : i + 5]
        left, right = low[around[0].start() : found[i].start()], low[found[i].end() : around[-1].end()]
        if any(c in toxicity.QUOTES for c in left) and any(c in toxicity.QUOTES for c in right):
            factor = 0.35
        else:
            factor = 0.6 if any(w in toxicity.REPORTING for w in words[max(0, i - 4) : i + 5]) else 1.0
        if hit[1]:
            fuzzy += factor * model.lexicon[hit[0]]
        else:
            exact += factor * model.lexicon[hit[0]]
    hits = exact + 0.7 * fuzzy
    x = [math.log1p(hits), math.log1p(1000 * hits / max(50, len(words))), math.log1p(exact), min(1.0, hits)] if seen else [0.0] * 4
    z = sum(a * b for a, b in zip([*x, 1.0], model.coefficients, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_query_matches_plain_scoring(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    marked = table(spark, sf, "labels").select("doc_id", "toxic").where(op_queries._fold(5) != 0)
    model = toxicity.train(docs.select("doc_id", "text").join(marked, "doc_id"))
    assert model.lexicon
    some = {r["doc_id"]: r["text"] or "" for r in docs.where("length(text) < 1500").collect()}
    found = {r["doc_id"]: r["score"] for r in entry.queries()["op5_toxicity"](spark, sf).collect()}
    assert max(abs(found[i] - plain_score(t, model)) for i, t in some.items()) < 1e-9
    assert sum(found[i] >= 0.5 for i in some) > 5


# --- Language -------------------------------------------------------------------------------


def plain_buckets(word):
    out, m = [], (1 << 32) - 1
    for a, b, c in zip([0, *map(ord, word)], [*map(ord, word)], [*map(ord, word[1:]), 0]):
        h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA6B & m) ^ (c * 0xC2B2AE35 & m)
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m
        out.append((h >> 12) % language_id.BUCKETS)
    return out


def plain_em(scores, allowed, rounds):
    share = {k: 1 / len(allowed) for k in allowed}
    for n in range(rounds + 1):
        fit, gained = 0.0, dict.fromkeys(allowed, 0.0)
        for s in scores:
            top = max(s)
            joint = {k: math.exp(s[k] - top) * share[k] for k in allowed}
            total = max(sum(joint.values()), 1e-300)
            fit += math.log(total) + top
            for k in allowed:
                gained[k] += joint[k] / total
        if n == rounds:
            return share, fit
        share = {k: max(v / len(scores), 1e-9) for k, v in gained.items()}
        share = {k: v / sum(share.values()) for k, v in share.items()}


def plain_language(text, table_):
    words = re.findall(r"[^\W\d_]+", text.lower())
    words = ["".join(c for c in w if c.isalpha()) for w in words]
    scores = [[sum(float(table_[b][k]) for b in plain_buckets(w)) for k in range(table_.shape[1])] for w in words if w]
    if not scores:
        return None
    allowed = list(range(table_.shape[1]))
    share, fit = plain_em(scores, allowed, language_id.ITERATIONS)
    while len(allowed) > 1:
        fewer = [k for k in allowed if k != min(allowed, key=lambda k: (share[k], k))]
        new, less = plain_em(scores, fewer, language_id.ITERATIONS // 2)
        if less < fit - language_id.PENALTY * math.log1p(len(scores)):
            break
        allowed, share, fit = fewer, new, less
    best = max(sorted(share), key=lambda k: share[k])
    return best, share[best]


def test_language_query_matches_plain_em(spark):
    docs = table(spark, SF, "documents")
    languages, learned = language_id.train(docs.select("doc_id", "text", "lang").where(op_queries._fold(3) != 1))
    found = {r["doc_id"]: r for r in op_queries.op2_language_id(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where(F.length("text") < 900).collect()}
    texts[-1] = None
    judged = 0
    for i, text in texts.items():
        if text is None or not all(c.isalpha() == bool(re.match(r"[^\W\d_]", c)) for c in set(text)):
            continue
        wanted = plain_language(text, learned)
        if wanted is None:
            assert found[i]["lang_pred"] == "und"
        else:
            judged += 1
            assert found[i]["lang_pred"] == languages[wanted[0]]
            assert abs(found[i]["score"] - wanted[1]) < 0.01
    assert judged > 20
    assert Counter(r["lang_pred"] for r in found.values()).total() == docs.count()
