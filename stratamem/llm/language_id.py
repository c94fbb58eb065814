"""Language identification as inference of a document's mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import lean, materialise, small_batches


#: Labelled documents of a language that training reads, about; they are chosen by hash.
TRAIN_DOCS = 1500
#: Buckets of the trigram table.
BUCKETS = 1 << 15
#: Languages up to which their sizes go to every task instead of the texts going to the sizes.
FEW_LANGUAGES = 10_000
SMOOTH = 0.05
ITERATIONS = 12
#: Weight of log(words) that a further language must gain in log likelihood.
PENALTY = 2.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, words, docs): trigram buckets of all words, first trigram of each word, text of each word.

    Words are maximal runs of letters in lower case; trigrams include the word's edges, so a
    word of n letters has n.
    """
    joined = "\n".join(texts) + "\n"
    low = joined.lower()
    if len(low) != len(joined):  # a letter that lower-cases to two would shift the texts
        low = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    at = np.flatnonzero(letter)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    inside = np.where(letter, codes, 0).astype(np.uint32)
    before = np.concatenate([np.zeros(1, np.uint32), inside[:-1]])
    after = np.concatenate([inside[1:], np.zeros(1, np.uint32)])
    mixed = (before[at] * np.uint32(0x9E3779B1)) ^ (inside[at] * np.uint32(0x85EBCA6B)) ^ (after[at] * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    buckets = ((mixed >> np.uint32(12)) % np.uint32(BUCKETS)).astype(np.int32)
    words = np.flatnonzero(before[at] == 0)
    return buckets, words, np.searchsorted(ends, at[words], side="right")


def _mixture(scores: np.ndarray, starts: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: (proportions, log likelihood) per text over its allowed languages.

    ``scores``: log likelihood of each word by language; texts' words follow each other from ``starts``.
    """
    top = scores.max(axis=1, keepdims=True)
    like = np.exp((scores - top).astype(np.float64))
    counts = np.diff(np.append(starts, len(doc)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for n in range(rounds + 1):
        joint = like * share[doc]
        total = np.maximum(joint.sum(axis=1), 1e-300)
        if n == rounds:
            return share, np.add.reduceat(np.log(total) + top[:, 0], starts)
        share = np.add.reduceat(joint / total[:, None], starts) / counts
        share = np.where(allowed > 0, np.maximum(share, 1e-9), 0)
        share /= share.sum(axis=1, keepdims=True)
    raise AssertionError


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, known): each text's mixture over the table's languages, and whether it has a letter.

    All languages are fitted at first. Then, as long as it costs less log likelihood than
    the penalty saved, each text gives up its least language and is fitted again.
    """
    buckets, words, of = trigrams(texts)
    languages = table.shape[1]
    known = np.zeros(len(texts), dtype=bool)
    shares = np.zeros((len(texts), languages))
    if not len(words):
        return shares, known
    scores = np.add.reduceat(table[buckets], words, axis=0)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    present = of[starts]
    doc = np.cumsum(np.diff(of, prepend=-1) > 0) - 1
    counts = np.diff(np.append(starts, len(of)))
    penalty = PENALTY * np.log1p(counts)
    allowed = np.ones((len(present), languages))
    share, fit = _mixture(scores, starts, doc, allowed, ITERATIONS)
    open_ = np.arange(len(present))
    for _ in range(languages - 1):
        trial = allowed[open_].copy()
        least = np.where(trial > 0, share[open_], np.inf).argmin(axis=1)
        trial[np.arange(len(open_)), least] = 0
        mine = np.isin(doc, open_)
        local = np.searchsorted(open_, doc[mine])
        new_share, new_fit = _mixture(scores[mine], np.flatnonzero(np.diff(local, prepend=-1)), local, trial, ITERATIONS // 2)
        better = new_fit >= fit[open_] - penalty[open_]
        take = open_[better]
        allowed[take], share[take], fit[take] = trial[better], new_share[better], new_fit[better]
        open_ = take
        if not len(open_):
            break
    known[present] = True
    shares[present] = share
    return shares, known


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, table): log probabilities of trigram buckets by language, from (doc_id, text, lang).

    Reads about ``per_language`` documents of each language, chosen by a hash of the id, so
    the counts sent to the driver are at most ``BUCKETS`` numbers a language. The sizes of
    the languages, one row each, are broadcast once they are known to be few, so texts are
    chosen where they are read.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "_lang"), "language-sizes")
    if sizes.count() <= FEW_LANGUAGES:
        sizes = F.broadcast(sizes)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) / 1e6
    sample = labelled.join(sizes, F.col("lang") == F.col("_lang")).where(chance * F.col("n") < per_language).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                mine = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                mine += np.bincount(trigrams(group["text"].tolist())[0], minlength=BUCKETS)
        for lang, c in counts.items():
            yield pd.DataFrame({"lang": lang, "bucket": np.flatnonzero(c), "n": c[np.flatnonzero(c)]})

    found = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = found.toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.full((BUCKETS, max(1, len(languages))), SMOOTH)
    for k, lang in enumerate(languages):
        mine = counted[counted["lang"] == lang]
        table[mine["bucket"].to_numpy(), k] += mine["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``lang_pred``, ``score``, ``mixture`` (language -> proportion).

    A document is a mixture of languages whose words are drawn by trigram likelihoods;
    expectation-maximisation estimates the proportions and penalised likelihood the set of
    languages. The prediction is the language of the largest proportion, which is its score.

    Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is
    every text if nothing was learned; of equal proportions the first language by name
    wins; repeated rows get equal predictions; null ids pass through; an empty table gives
    an empty result; only the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS rows by learned languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            shares, known = np.zeros((len(texts), shared.value.shape[1])), np.zeros(len(texts), dtype=bool)
            first = 0
            while first < len(texts) and languages:  # blocks of about a million characters
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= 1 << 20):
                    size += len(texts[last])
                    last += 1
                shares[first:last], known[first:last] = infer(texts[first:last], shared.value)
                first = last
            best = shares.argmax(axis=1)
            score = np.where(known, shares.max(axis=1), 0.0)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
                    "score": np.clip(score, 0, 1),
                    "mixture": [{languages[i]: float(s[i]) for i in np.flatnonzero(s > 1e-3)} if k else {} for s, k in zip(shares, known, strict=True)],
                }
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return rows.mapInPandas(lean(run), f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")


def identify(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows of ``docs`` that the condition ``training`` (on column ``doc_id``) admits, predict all.

    Edge cases as in ``predict``; rows with a null id, text or language are not learned from.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, table = train(rows.where(training & F.col("doc_id").isNotNull()))
    return predict(docs, languages, table, id_col, text_col)
