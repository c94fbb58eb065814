"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem.functions import fixed as V

TOKEN = r"[\p{L}\p{N}_]{3,}"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """White space of all kinds removed from both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the stripped, lower-cased text."""
    return F.left(F.sha2(F.lower(strip(text)), 256), F.lit(16))


def slugify(text: Column, longest: int = 80) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, none at the ends, cut."""
    slug = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(longest))


def is_slug(text: Column) -> Column:
    """Whether a slug is valid."""
    return text.rlike(r"^[a-z0-9][a-z0-9-]*$") & (F.length(text) <= 80)


def tokens(text: Column) -> Column:
    """Words of three characters or more, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs in the text."""
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def count_any(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)))


def is_significant(text: Column) -> Column:
    """Long enough and with a keyword."""
    return bind(text, lambda x: (F.length(strip(x)) >= V.SIGNIFICANT_CHARS) & bind(F.lower(x), lambda low: has_any(low, V.SIGNIFICANT_KEYWORDS)))


def abuse_reason(text: Column) -> Column:
    """Why a text is suspect, or null; the first reason wins."""
    reason = F.when(F.octet_length(text) > V.MAX_CONTENT_BYTES, F.lit("content_over_10kb"))
    for pattern in V.SHELL_PATTERNS:
        reason = reason.when(text.rlike(pattern), F.lit(f"shell_payload_pattern:{pattern}"))
    return reason


def group_id_reason(group_id: Column) -> Column:
    """Why a group id is not canonical, or null."""
    return F.when(strip(group_id) == "", F.lit("empty_or_non_string")).when(~group_id.rlike(V.GROUP_ID_PATTERN), F.lit("non_canonical_shape"))


def prose(text: Column) -> Column:
    """The text without blank lines and lines of code."""

    def is_prose(line: Column) -> Column:
        bare = strip(line)
        letters = F.length(F.regexp_replace(bare, r"\P{L}", ""))
        code = F.lit(False)
        for pattern in V.CODE_PATTERNS:
            code = code | line.rlike(f"^(?:{pattern})")
        sparse = (F.length(bare) > 5) & (letters / F.greatest(F.length(bare), F.lit(1)) < 0.4)
        return (bare != "") & ~sparse & ~code

    return F.array_join(F.filter(F.split(text, "\n", -1), is_prose), "\n")


def memory_type(low: Column) -> Column:
    """The first type with a keyword in a lower-cased text, or null."""
    found = None
    for kind, words in V.TYPE_KEYWORDS.items():
        test = has_any(low, words)
        found = F.when(test, F.lit(kind)) if found is None else found.when(test, F.lit(kind))
    return found


def classify(text: Column) -> Column:
    """``struct<type, confidence, sentiment>`` of a memory's text."""
    words = F.create_map(*(x for name, ws in V.TYPE_KEYWORDS.items() for x in (F.lit(name), F.array(*(F.lit(w) for w in ws)))))

    def described(kind: Column, low: Column) -> Column:
        hits = F.size(F.filter(F.coalesce(F.try_element_at(words, kind), F.array().cast("array<string>")), lambda w: F.contains(low, w)))
        sure = F.when(kind.isin(*V.TYPE_KEYWORDS), F.bround(F.greatest(F.lit(0.3), F.least(F.lit(1.0), hits / 5.0 + 0.1)), 2)).otherwise(F.lit(0.3))
        return F.struct(kind.alias("type"), sure.alias("confidence"), sentiment(low).alias("sentiment"))

    def judged(low: Column) -> Column:
        first = F.coalesce(memory_type(low), F.lit("fact"))
        kind = bind(first, lambda k: F.when(k.isin("question", "hypothesis") & has_any(low, V.RESOLUTION_KEYWORDS), F.lit("outcome")).otherwise(k))
        return bind(kind, lambda k: described(k, low))

    return bind(F.lower(bind(prose(text), lambda p: F.when(p == "", text).otherwise(p))), judged)


def sentiment(low: Column) -> Column:
    """``positive``, ``negative`` or ``neutral``, by the distinct words of a lower-cased text."""
    words = F.split(low, r"\s+")
    good = F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in V.POSITIVE_WORDS))))
    bad = F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in V.NEGATIVE_WORDS))))
    return F.when(good > bad, F.lit("positive")).when(bad > good, F.lit("negative")).otherwise(F.lit("neutral"))


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
    return total


def _certainty(hits: Column) -> Column:
    return bind(hits, lambda n: F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.95), 1.0 - 0.45 * F.pow(F.lit(0.55), n))))


def detect_layer(text: Column, kind: Column, agents: tuple[str, ...] = ("assistant",), owners: tuple[str, ...] = ("owner",)) -> Column:
    """``struct<layer, confidence>``: world knowledge, agent operations or session only.

    Each pattern runs over a text once at most, and only where the kind leaves it open.
    """
    names = {"agents": "|".join(agents), "owners": "|".join(owners)}
    agent_patterns = tuple(p.format(**names) if "{agents}" in p or "{owners}" in p else p for p in V.AGENT_PATTERNS)

    def layer(name: str, sure: Column) -> Column:
        return F.struct(F.lit(name).alias("layer"), F.bround(sure, 2).alias("confidence"))

    def vague(words: Column) -> Column:
        pronouns = F.size(F.filter(words, lambda w: w.isin(*V.PRONOUNS)))
        return F.size(words).between(3, 40) & (pronouns / F.greatest(F.size(words), F.lit(1)) >= 0.25)

    def untyped(text: Column, low: Column, a: Column, s: Column) -> Column:
        unclear = bind(F.regexp_extract_all(low, F.lit("[a-zA-Z']+"), F.lit(0)), vague) & ~text.rlike(r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*\b")
        scores = F.struct(a.alias("a"), F.when(unclear, F.greatest(s, F.lit(0.75))).otherwise(s).alias("s"))
        return bind(
            scores,
            lambda x: F.when((x["a"] >= x["s"]) & (x["a"] >= 0.5), layer("agent_operations", x["a"]))
            .when((x["s"] > x["a"]) & (x["s"] >= 0.5), layer("session_ephemeral", x["s"]))
            .otherwise(layer("world_knowledge", _certainty(_hits(low, V.WORLD_PATTERNS)))),
        )

    def judged(x: Column) -> Column:
        text, low, kind = x["text"], x["low"], x["kind"]
        agent, session, world = _hits(low, agent_patterns), _hits(low, V.SESSION_PATTERNS), _hits(low, V.WORLD_PATTERNS)
        return (
            F.when(kind.isin(*V.AGENT_TYPES), layer("agent_operations", F.greatest(F.lit(0.85), _certainty(agent + 1))))
            .when(kind.isin(*V.SESSION_TYPES), layer("session_ephemeral", F.greatest(F.lit(0.85), _certainty(session + 1))))
            .when(kind.isin(*V.WORLD_TYPES), layer("world_knowledge", _certainty(world + 1)))
            .otherwise(bind(_certainty(session), lambda s: untyped(text, low, _certainty(agent), s)))
        )

    return bind(
        F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lower(F.coalesce(text, F.lit(""))).alias("low"), F.lower(F.trim(F.coalesce(kind, F.lit("")))).alias("kind")),
        judged,
    )


def intent(query: Column) -> Column:
    """``multi_hop``, ``temporal``, ``event``, ``entity`` or ``general``, the first that applies."""
    low = F.lower(query)

    def nouns(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(V.NOUN_PATTERN), F.lit(0)), F.lower)
        return F.filter(F.array_distinct(found), lambda n: ~F.substring_index(n, " ", 1).isin(*V.ENTITY_STOPWORDS))

    count, linked = F.size(nouns(query)), has_any(low, V.ASSOCIATIVE_PHRASES)
    first = F.slice(F.filter(F.split(strip(query), r"\s+"), lambda w: w != ""), 1, 2)
    titled = (F.size(first) == 2) & F.forall(first, lambda w: w.rlike(r"^\p{Lu}.")) & ~F.lower(F.try_element_at(first, F.lit(1))).isin(*V.ENTITY_STOPWORDS)
    named = (F.size(nouns(F.concat(F.lit(" "), strip(query)))) > 0) | titled
    phrases = "|".join(re.escape(p).replace(r"\ ", " ") for p in V.TEMPORAL_PHRASES)
    when = low.rlike(rf"\b(?:{phrases})\b") | low.rlike(rf"\b(?:{'|'.join(V.TEMPORAL_WORDS)})\b")
    when = when | query.rlike(r"\b(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}/\d{1,2}/\d{1,2})\b")
    words = F.regexp_extract_all(low, F.lit(r"\b[a-z]+\b"), F.lit(0))
    happened = F.arrays_overlap(words, F.array(*(F.lit(w) for w in V.EVENT_WORDS)))
    empty = query.isNull() | (strip(query) == "")
    return (
        F.when(empty, F.lit("general"))
        .when((count >= 2) | ((count >= 1) & linked), F.lit("multi_hop"))
        .when(when, F.lit("temporal"))
        .when(happened, F.lit("event"))
        .when(named, F.lit("entity"))
        .otherwise(F.lit("general"))
    )


def expandable(query: Column) -> Column:
    """More than three words."""
    return F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) > 3


def full_text_query(query: Column) -> Column:
    """The query without characters that full-text syntax reserves, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r'[+\-&|!(){}\[\]^"~*?:\\/]', " "), r"\s+", " "))


def sanitise(text: Column, longest: int = 500) -> Column:
    """Non-printing characters as spaces, white space collapsed, cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{C}", " "), r"\s+", " ")), F.lit(longest))


def hall(kind: Column) -> Column:
    """The hall of a memory type; ``context`` for others."""
    pairs = [F.lit(x) for kv in V.HALLS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("context"))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word; the text is only taken apart where it has the word."""
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(~F.contains(text, word), 0).otherwise((gone / F.length(word)).cast("int"))


def room(text: Column, rooms: dict[str, tuple[str, ...]], least: int = 2) -> Column:
    """The room of ``rooms`` whose keywords occur most, long ones twice; of equal rooms the first; ``general`` below ``least``."""

    def best_of(low: Column) -> Column:
        scored = []
        for n, (name, words) in enumerate(rooms.items()):
            pairs = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(2 if len(w) > 6 else 1).alias("weight")) for w in words))
            score = F.aggregate(pairs, F.lit(0), lambda s, x: s + occurrences(low, x["word"]) * x["weight"])
            scored.append(F.struct(score.alias("score"), F.lit(-n).alias("order"), F.lit(name).alias("room")))
        return F.array_max(F.array(*scored))

    named = bind(bind(F.lower(text), best_of), lambda b: F.when(b["score"] >= least, b["room"]).otherwise(F.lit("general")))
    return F.coalesce(named, F.lit("general"))


def broken_citations(text: Column) -> Column:
    """The kinds of broken citation in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in V.CITATION_PATTERNS.items())))
