"""Secret scan over a trigram inverted index: Boolean queries from regexes, postings, verification."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex both Java and Python read alike, and lengths a match must reach."""

    kind: str
    pattern: str
    least: int = 0
    #: Group whose length counts; 0 is the whole match.
    group: int = 0


#: The patterns and lengths of the base kinds.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Public formats beyond the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + MORE

#: Sets of strings larger than this are given up as a source of trigrams.
MOST_STRINGS = 64

# A query is a tuple of alternatives, each a frozenset of trigrams that must all occur;
# ANY (one alternative without trigrams) is met by every text.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _simplify(query: Query) -> Query:
    return frozenset(x for x in query if not any(y < x for y in query))


def _and(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS:
        return a if len(a) <= len(b) else b
    return _simplify(frozenset(x | y for x, y in product(a, b)))


def _trigrams_of(strings: frozenset[str]) -> Query:
    """One of ``strings`` occurs: its trigrams do."""
    return _simplify(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _class_letters(items: list) -> frozenset[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= 8 else None


def _walk(nodes) -> tuple[Query, frozenset[str]]:
    """(query, strings): the query holds, and if ``strings`` isn't empty a match is one of them, exactly.

    Runs of exactly known strings are joined as long as they stay few; where the run ends,
    its trigrams join the query.
    """
    query, run, exact = ANY, frozenset([""]), True
    for kind, value in nodes:
        strings: frozenset[str] | None = None
        inner: Query = ANY
        if kind is sre.LITERAL:
            strings = frozenset([chr(value).lower()])
        elif kind is sre.IN:
            strings = _class_letters(value)
        elif kind is sre.SUBPATTERN:
            inner, found = _walk(value[3])
            strings = found or None
        elif kind is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            strings = frozenset().union(*(s for _, s in parts)) if all(s for _, s in parts) else None
            inner = _simplify(frozenset().union(*(_and(q, _trigrams_of(s)) if s else q for q, s in parts)))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            body_query, found = _walk(body)
            if found and most == 1:
                strings = found | frozenset([""]) if least == 0 else found
            elif found and least == most and len(found) ** least <= MOST_STRINGS:
                strings = frozenset("".join(x) for x in product(found, repeat=least))
            elif least > 0:
                inner = body_query
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        query = _and(_and(query, _trigrams_of(run)), inner)
        exact = False
        run = frozenset([""]) if strings is None else strings
    if exact:
        return query, run
    return _and(query, _trigrams_of(run)), frozenset()


def trigram_query(pattern: str) -> Query:
    """The trigrams a text (in lower case) must have to match ``pattern``: alternatives of sets.

    ``ANY`` if the pattern has no mandatory trigrams.
    """
    query, strings = _walk(sre_parser.parse(pattern))
    return _and(query, _trigrams_of(strings)) if strings else query


#: Documents of a block of the index, about.
BLOCK_DOCS = 4096


def _needed(queries: dict[str, Query]) -> list[str]:
    return sorted({g for q in queries.values() for alternative in q for g in alternative})


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(row key, trigram): the index entries of the given trigrams, over lower-cased texts.

    The index holds the trigrams that the rules ask for, and every document that has them.
    """
    low = docs.select("doc_id", F.lower("content").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams)))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): the inverted index of ``docs`` (doc_id, content), a written table of sorted posting lists.

    Documents are dealt by id into blocks of about ``BLOCK_DOCS``, the same for every trigram,
    so a list is bounded even for a trigram that nearly every document has, and lists that
    are to be intersected lie in one block. Ids that repeat are one entry, combined before
    the shuffle.
    """
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    entries = postings(docs, trigrams).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    return materialise(entries.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids")), "trigram-index")


def _of_kind(ids: Column, kind: str) -> Column:
    """The ids as structs with the rule's kind."""
    return F.transform(ids, lambda i: F.struct(i.alias("doc_id"), F.lit(kind).alias("kind")))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): documents in the posting lists that a rule's query asks for, with the kinds of those rules.

    In each block the lists of an alternative's trigrams are intersected, and alternatives
    united. The rules are literals of the plan.
    """
    wanted = index.where(F.col("trigram").isin(_needed(queries)))
    blocks = wanted.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast(index.schema["ids"].dataType)
    met = []
    for kind, query in queries.items():
        alternatives = [reduce(F.array_intersect, [F.coalesce(F.try_element_at("lists", F.lit(g)), none) for g in sorted(a)]) for a in sorted(query, key=sorted)]
        met.append(_of_kind(reduce(F.array_union, alternatives), kind))
    hits = blocks.select(F.explode(F.concat(*met)).alias("hit")).select("hit.doc_id", "hit.kind")
    return hits.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans(content: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches in ``content`` as ``array<struct<start, kind, end>>``.

    Positions are code points, the end exclusive. They follow from the lengths of the
    matches and of the pieces between them, so only a document's matches are folded.
    """
    order = [r.kind for r in RULES].index(rule.kind)
    # a match that is a run of one class stays the same when the pattern asks for its length
    pattern = re_least(rule) if rule.least and not rule.group else rule.pattern
    matches = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(content, F.lit(pattern), F.lit(rule.group)) if rule.group else matches
    between = F.split(content, pattern, -1)
    kind = "struct<start:int,kind:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    parts = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(counted, F.length).alias("counts"))

    def step(state, x):
        first = state["at"] + x["gap"]
        last = first + F.coalesce(x["size"], F.lit(0))
        hit = F.struct(first.alias("start"), F.lit(order).alias("kind"), last.alias("end"))
        grown = F.when(x["counts"] >= rule.least, F.concat(state["found"], F.array(hit))).otherwise(state["found"])
        return F.struct(last.alias("at"), grown.alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def re_least(rule: Rule) -> str:
    """The pattern of a rule that ends in ``[class]+``, asking for ``rule.least`` characters in all."""
    head = rule.pattern[: rule.pattern.index("[")]
    return f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}"


def _joined(found: Column) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``found``, all spans by start, then kind in the order of ``RULES``.

    Rules with mandatory trigrams are verified only on the documents that the index gives;
    the others (``hex``) scan every text.

    Edge cases: null text counts as empty; rows without an id are scanned fully, as the
    index can't name them; rows that share an id share its candidates, and each is
    verified by itself; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    queries = {r.kind: q for r in RULES if (q := trigram_query(r.pattern)) != ANY}
    index = build_index(rows.where(F.col("doc_id").isNotNull()), _needed(queries))
    named = candidates(index, queries)
    joined = rows.join(named.withColumnRenamed("doc_id", "_named"), F.col("doc_id") == F.col("_named"), "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = F.col("doc_id").isNull()
    parts = []
    for rule in RULES:
        found = spans(F.col("content"), rule)
        if rule.kind in queries:
            found = F.when(every | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), found).otherwise(nothing)
        parts.append(found)
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, of what ``scan`` returns."""

    def of(kind: int) -> Column:
        return F.filter("found", lambda x: x["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
