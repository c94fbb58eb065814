"""Toxicity scores from a learned lexicon, fuzzy matching and the context of each hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import lean, small_batches

#: Labelled documents that training reads, about, of each label; they are chosen by hash.
TRAIN_DOCS = 3000
#: Distinct training texts that a new term must explain; so a lexicon has a third as many terms as there are toxic ones, at most.
MIN_GAIN = 3
#: Share of the toxic training texts that have a word which counts although other terms explain them.
OFTEN = 0.05
#: Share of toxic texts among those that have the term, as if both labels were as frequent and
#: DOUBT more clean texts had it.
MIN_PRECISION, DOUBT = 0.9, 3
#: Shortest stem, and shortest term that may be misspelled.
STEM, FUZZY = 4, 5
#: Words around a hit that are read as its context.
CONTEXT = 4

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
QUOTES = frozenset("\"“”„«»‹›‘’")
#: Words that report speech.
REPORTING = frozenset(
    "said says wrote writes quoted quote called calls word term insult dit écrit cité mot sagte schrieb zitiert wort dijo escribió citado palabra".split()
)
#: Hits count this much where quoted, where reported, and where misspelled.
QUOTED, REPORTED, MISSPELLED = 0.35, 0.6, 0.7


class Trie:
    """The lexicon's words as a trie of dicts; key ``""`` marks a term, ``"*"`` a stem."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = term


class Matcher:
    """The Levenshtein automata of all words within one edit of the trie, run as one automaton.

    A state is a set of (trie node, edits spent, word so far is long enough); it is the
    intersection of the trie with the nondeterministic automaton that reads the text's
    word, made deterministic as words reach it. Most words die within a few characters.
    """

    def __init__(self, terms: list[str]):
        self.exact = {t for t in terms if not t.endswith("*")}
        self.trie = Trie(terms)
        self.nodes: list[dict] = []
        self.depth: list[int] = []
        self.number: dict[int, int] = {}
        self._add(self.trie.root, 0)
        self.start = self._close({(0, 0)})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.words: dict[str, tuple[str, int] | None] = {}

    def _add(self, node: dict, depth: int) -> None:
        self.number[id(node)] = len(self.nodes)
        self.nodes.append(node)
        self.depth.append(depth)
        for c, child in node.items():
            if isinstance(child, dict):
                self._add(child, depth + 1)

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that skipping a letter of the lexicon's word reaches."""
        more = set(states)
        for n, edits in states:
            if edits == 0 and n:
                more |= {(self.number[id(child)], 1) for child in self.nodes[n].values() if isinstance(child, dict)}
        return frozenset(x for x in more if x[1] == 0 or (x[0], 0) not in more)

    def _step(self, state: frozenset, letter: str) -> frozenset:
        key = (state, letter)
        if (found := self.steps.get(key)) is None:
            following = set()
            for n, edits in state:
                node = self.nodes[n]
                if isinstance(child := node.get(letter), dict):
                    following.add((self.number[id(child)], edits))
                if edits == 0 and n:  # a wrong or a further letter, but not the first
                    following.add((n, 1))
                    following |= {(self.number[id(child)], 1) for child in node.values() if isinstance(child, dict)}
            found = self.steps[key] = self._close(following)
        return found

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None; edits only in terms of ``FUZZY`` letters or more."""
        if word in self.exact:
            return word, 0
        state, best = self.start, None
        for i, letter in enumerate(word):
            state = self._step(state, letter)
            if not state:
                break
            last = i == len(word) - 1
            for n, edits in state:
                node = self.nodes[n]
                if edits and self.depth[n] < FUZZY:
                    continue
                term = node.get("*") if not edits or last else None
                term = term or (node.get("") if last else None)
                if isinstance(term, str) and (best is None or (edits, term) < (best[1], best[0])):
                    best = term, edits
            if best and best[1] == 0:
                break
        return best

    def lookup(self, word: str) -> tuple[str, int] | None:
        """``find`` with a memo."""
        try:
            return self.words[word]
        except KeyError:
            if len(self.words) > 150_000:
                self.words.clear()
            if len(self.steps) > 300_000:
                self.steps.clear()
            found = self.words[word] = self.find(word)
            return found


def features(text: str, matcher: Matcher, weights: dict[str, float]) -> list[float]:
    """Evidence in a text: of all hits, of their share, of exact ones alone, and whether there is a whole one."""
    low = text.lower()
    words = WORD.findall(low)
    lookup = matcher.lookup
    distinct = {w: f for w in set(words) if (f := lookup(w))}
    if not distinct:
        return [0.0, 0.0, 0.0, 0.0]
    exact = fuzzy = 0.0
    spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
    for i, word in enumerate(words):
        if (found := distinct.get(word)) is None:
            continue
        a, b = spans[max(0, i - CONTEXT)][0], spans[min(len(words) - 1, i + CONTEXT)][1]
        left, right = low[a : spans[i][0]], low[spans[i][1] : b]
        factor = 1.0
        if not QUOTES.isdisjoint(left) and not QUOTES.isdisjoint(right):
            factor = QUOTED
        elif not REPORTING.isdisjoint(words[max(0, i - CONTEXT) : i + CONTEXT + 1]):
            factor = REPORTED
        if found[1] == 0:
            exact += factor * weights[found[0]]
        else:
            fuzzy += factor * weights[found[0]]
    hits = exact + MISSPELLED * fuzzy
    return [math.log1p(hits), math.log1p(1000 * hits / max(50, len(words))), math.log1p(exact), min(1.0, hits)]


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in range(STEM, min(len(w), 8))}


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """term -> weight, by greedy cover of the toxic texts.

    Terms are counted text by text; only those of toxic texts are held, and of them only the
    frequent ones after the first pass.

    Candidates are words, and stems (they end in an asterisk) of ``STEM`` letters or more. A term is taken while it
    explains ``MIN_GAIN`` texts that no earlier term does, so words that merely come along
    with the copies of one text add nothing. A weight is the squared log odds of the term's
    precision over 25, 1 at most, so one chance hit of a doubtful term is little evidence.
    """
    rows = list({t: y for t, y in zip(texts, toxic, strict=True)}.items())
    bad: Counter = Counter()
    for text, label in rows:
        if label:
            bad.update(_terms(text))
    bad = Counter({t: n for t, n in bad.items() if n >= MIN_GAIN})
    good: Counter = Counter()
    for text, label in rows:
        if not label:
            good.update(t for t in _terms(text) if t in bad)
    n_bad = max(1, sum(label for _, label in rows))
    share = n_bad / max(1, len(rows) - n_bad)
    precise = {t: p for t, n in bad.items() if (p := n / (n + (good[t] + DOUBT) * share)) >= MIN_PRECISION}
    covers: dict[str, set[int]] = {}
    for k, (text, label) in enumerate(rows):
        if label:
            for t in _terms(text).intersection(precise):
                covers.setdefault(t, set()).add(k)
    lexicon: dict[str, float] = {}
    while covers:
        # of equal cover the plain word, then the longer term, then by name
        term = max(covers, key=lambda t: (len(covers[t]), not t.endswith("*"), len(t), t))
        if len(covers[term]) < MIN_GAIN:
            break
        gone = covers.pop(term)
        lexicon[term] = precise[term]
        for t in list(covers):
            covers[t] -= gone
            if len(covers[t]) < MIN_GAIN:
                del covers[t]
    # a word that is as precise by itself also counts where others explained its texts
    lexicon.update({t: p for t, p in precise.items() if not t.endswith("*") and bad[t] >= OFTEN * n_bad and t not in lexicon})
    return {t: min(1.0, (math.log(p / (1 - p)) / 5) ** 2) if p < 1 else 1.0 for t, p in lexicon.items()}


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression with a constant, by Newton's method; one clean text without evidence is added.

    Evidence never speaks for a text: a feature with a negative weight is left out, and the
    others are fitted again.
    """
    x, y = np.vstack([x, np.zeros(x.shape[1])]), np.append(y, 0.0)
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    used = np.arange(x.shape[1])
    while True:
        z, w = x[:, used], np.zeros(len(used))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep[used]), z.T @ (y - p) - keep[used] * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        wrong = np.flatnonzero(w[:-1] < 0)
        if not len(wrong):
            break
        used = np.delete(used, wrong)
    out = np.zeros(x.shape[1])
    out[used] = w
    return out


class Model:
    """What scoring needs; the automaton is built anew in each process."""

    def __init__(self, lexicon: dict[str, float], coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients
        self.matcher: Matcher | None = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coefficients": self.coefficients, "matcher": None}

    def evidence(self, texts: list[str]) -> np.ndarray:
        """``features`` of each text."""
        if self.matcher is None:
            self.matcher = Matcher(list(self.lexicon))
        return np.array([features(t, self.matcher, self.lexicon) for t in texts]).reshape(-1, 4)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability that each text is toxic."""
        z = np.hstack([self.evidence(texts), np.ones((len(texts), 1))]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(labelled: DataFrame, per_label: int = TRAIN_DOCS) -> Model:
    """A model from (doc_id, text, toxic); the driver reads about ``per_label`` rows of each label, chosen by hash."""
    labelled = labelled.where("toxic is not null and text is not null").withColumn("toxic", (F.col("toxic") != 0).cast("int"))
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) / 1e6
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == label) & (chance < per_label / n))
    rows = labelled.where(chosen).select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "toxic", "text"])
    texts, toxic = rows["text"].tolist(), rows["toxic"].tolist()
    model = Model(learn_lexicon(texts, toxic), np.array([0.0, 0.0, 0.0, 0.0, -3.0]))
    if len(set(toxic)) == 2:
        x, y = model.evidence(texts), np.array(toxic, dtype=float)
        model.coefficients = fit(x, y)
    elif toxic:
        model.coefficients = np.array([0.0, 0.0, 0.0, 0.0, 3.0 if toxic[0] else -3.0])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``score``, the probability that it is toxic.

    Words are matched to the model's lexicon exactly, by stem, or within one edit (not in
    the first letter); a hit inside quotation marks or beside a word that reports speech
    counts less. A logistic regression weighs the evidence.

    Edge cases: null and empty texts have no evidence and get the score of that; repeated
    rows get equal scores; null ids pass through; an empty table gives an empty result;
    only the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded training sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.scores(batch["text"].fillna("").tolist())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInPandas(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame, training) -> tuple[Model, DataFrame]:
    """A model from the labels that the condition ``training`` (on ``doc_id``) admits, and ``score`` of all ``docs``.

    Edge cases as in ``score``; a document with several labels is learned from once for
    each; without labels of both kinds every score is the same.
    """
    marked = labels.select(F.col("doc_id"), "toxic").where(training)
    model = train(docs.select("doc_id", "text").join(marked, "doc_id"))
    return model, score(docs, model)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns.

    One pass: the rows go through the model as they are, so nothing is joined back. Edge
    cases as in ``score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [t or "" for t in part.column(position).to_pylist()]
                yield part.filter(pa.array(shared.value.scores(texts) < limit))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)
