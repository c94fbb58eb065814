"""Language and toxicity: learned models, held-out accuracy and edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratamem.llm import language_id, toxicity
from stratamem.sources.tables import table
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_query_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    found = entry.queries()["op2_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_mixtures_are_estimated(spark):
    docs = table(spark, SF, "documents").where("length(text) > 2000")
    languages, model = language_id.train(docs)
    by = {lang: docs.where(F.col("lang") == lang).first()["text"] for lang in ("en", "de")}
    half = by["en"][:1500] + "\n" + by["de"][:1500]
    shares, known = language_id.infer([half, by["en"], "12 .. 5"], model)
    mixed = dict(zip(languages, shares[0]))
    assert 0.3 < mixed["en"] < 0.7 and 0.3 < mixed["de"] < 0.7
    assert np.count_nonzero(shares[1] > 0.05) == 1
    assert known.tolist() == [True, True, False]


def test_likelihood_never_falls():
    rng = np.random.default_rng(0)
    scores, doc = rng.normal(size=(300, 4)), np.repeat(np.arange(10), 30)
    starts, allowed = np.arange(0, 300, 30), np.ones((10, 4))
    fits = [language_id._mixture(scores, starts, doc, allowed, n)[1] for n in range(8)]
    assert all((b >= a - 1e-9).all() for a, b in zip(fits, fits[1:]))


def test_language_edge_cases(spark):
    source = cases.docs(spark)
    found = language_id.identify(source, F.lit(True)).collect()
    assert len(found) == len(cases.rows())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert got[1] == got[2] == got[11] == ("und", 0.0)
    assert got[4][0] in {"en", "de", "ja"}
    nothing = language_id.identify(source, F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.identify(cases.empty(spark), F.lit(True)).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    found = entry.queries()["op5_toxicity"](spark, d).collect()
    assert len(found) == table(spark, d, "documents").count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    toxic = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert sum(toxic) >= 0.85 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


@pytest.mark.parametrize(
    ("word", "found"),
    [
        ("idiot", ("idiot", 0)),
        ("idiott", ("idiot", 1)),
        ("idot", ("idiot", 1)),
        ("idjot", ("idiot", 1)),
        ("xdiot", None),
        ("iidjot", None),
        ("scumy", None),
        ("lowei", ("lowei*", 0)),
        ("loweischaft", ("lowei*", 0)),
        ("the", None),
    ],
)
def test_automaton(word, found):
    assert toxicity.Matcher(["idiot", "scum", "lowei*"]).find(word) == found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng = np.random.default_rng(5)
    terms = ["abcab", "bcabca", "aabbcc"]
    matcher = toxicity.Matcher(terms)
    for _ in range(3000):
        word = "".join(rng.choice(list("abc"), rng.integers(3, 9)))
        near = [t for t in terms if distance(word, t) <= 1 and word[0] == t[0]]
        assert (matcher.find(word) is not None) == bool(near), word


def test_quotation_counts_less():
    weights = {"idiot": 1.0}
    matcher = toxicity.Matcher(list(weights))
    plain = toxicity.features("you are an idiot and that is all there is to say here", matcher, weights)
    quoted = toxicity.features('they put “an idiot” on the sign and that is all there is', matcher, weights)
    reported = toxicity.features("the word idiot and that is all there is to say here", matcher, weights)
    assert plain[0] > reported[0] > quoted[0] > 0


def test_copies_add_no_terms():
    texts = [f"some rare{i} words of one text idiot" for i in range(9)] + ["only once copied phrase"] * 50 + [f"clean text {i} here" for i in range(50)]
    lexicon = toxicity.learn_lexicon(texts, [1] * 59 + [0] * 50)
    assert "idiot" in lexicon and "phrase" not in lexicon


def test_toxicity_edge_cases(spark):
    source = cases.docs(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 1), (99, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    _, scored = toxicity.learn_and_score(source, labels, F.lit(True))
    rows = scored.collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    model, scored = toxicity.learn_and_score(source, labels.where("false"), F.lit(True))
    assert len({r["score"] for r in scored.collect()}) == 1
    assert toxicity.score(cases.empty(spark), model).count() == 0
    kept = toxicity.keep_clean(source, model)
    assert kept.columns == source.columns and kept.count() == len(cases.rows())
