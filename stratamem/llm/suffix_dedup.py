"""Removal of repeated byte strings: suffix arrays per shard, merged across shards.

Only text around an anchor that occurs more than once can hold a repeated string, so only
that text is brought together, in shards by anchor: the work follows the repeated part of
the corpus, not all pairs of shards. Passages of words that documents share go the same way,
with words in the place of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import arrow_rows, lean, materialise, release, small_batches

LENGTH = 400
#: Bytes that an anchor's hash covers (a power of two).
GRAM = 32
#: Words of a passage that counts as shared, and words that its anchor's hash covers.
PASSAGE, PASSAGE_GRAM = 51, 8
#: Bytes of text in a shard, about; its arrays stay in cache.
SHARD = 1 << 18
#: Distinct contexts of an anchor beyond which they are dealt over several shards.
HOT = 1024
#: Strings that one task of the merge across shards sorts, about.
BUCKET = 1 << 19

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = 24  # bits of a packed number that hold a position; a block of texts is shorter


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def run_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` of the hashed symbols, from those of half the size; of any
    other size than a power of two, from the two overlapping runs of one that cover it."""
    h, width, factor = symbols, 1, _M1
    while 2 * width <= size:
        h = h[:-width] * factor + h[width:]
        width *= 2
        factor = np.uint64(int(factor) ** 2 & (1 << 64) - 1)
    h = _mix(h)
    if width < size:
        h = _mix(h[: max(0, len(symbols) - size + 1)] * _M1 + h[size - width :][: max(0, len(symbols) - size + 1)])
    return h


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """The bytes as hashed symbols."""
    return (data.astype(np.uint64) + np.uint64(1)) * _M1


_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0xF1357AEA2E62A9C5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(count - 1, base)), dtype=np.uint64)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of each word: a maximal run of bytes above the space."""
    edges = np.flatnonzero(np.diff((data > 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def word_symbols(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The words as hashed symbols: polynomials of their bytes, from sums up to each byte, block by block."""
    out, first = np.empty(len(start), dtype=np.uint64), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + BLOCK, side="right")))
        begin, end = int(start[first]), int(stop[last - 1])
        size = 1 << (end - begin).bit_length()
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[data[begin:end]] * _powers(_BASE, size)[: end - begin], dtype=np.uint64))
        a, b = start[first:last] - begin, stop[first:last] - begin
        out[first:last] = _mix((sums[b] - sums[a]) * _powers(_INVERSE, size)[a])
        first = last
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` numbers, by doubling."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


_COLUMNS = ("text", "anchor", "context", "first", "last", "left", "right")


def _anchored(symbols: np.ndarray, of: np.ndarray, length: int, gram: int, part: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, context, first, last, left, right) over the symbols of several texts; ``of`` has each symbol's text."""
    grams = run_hashes(symbols, gram) ^ np.uint64(seed)
    low = np.uint64((1 << _POS) - 1)
    packed = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    least = sliding_min(packed, length - gram + 1)
    at = np.flatnonzero(of[: len(least)] == of[length - 1 :])
    change = np.ones(len(at), dtype=bool)
    change[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[change]
    last = np.append(at[np.flatnonzero(change)[1:] - 1], at[-1:])
    place = (low - (least[first] & low)).astype(np.int64)
    own = of[first]
    side = (length - gram + 1) // 2 + gram
    halves = run_hashes(symbols, side) | np.uint64(1)
    from_left = place + gram - side
    fits = np.clip(from_left, 0, None)
    left = np.where((from_left >= 0) & (of[fits] == own), halves[np.minimum(fits, len(halves) - 1)], np.uint64(0))
    stop = place + side - 1
    right = np.where((stop < len(of)) & (of[np.minimum(stop, len(of) - 1)] == own), halves[np.minimum(place, len(halves) - 1)], np.uint64(0))
    context = _range_hashes(symbols, first, last + length, part)
    context = _mix(context * _M1 + (place - first).astype(np.uint64))
    return grams[place].view(np.int64), context.view(np.int64), first, last, left.view(np.int64), right.view(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH) -> pd.DataFrame:
    """The anchors of the texts: ``text``, ``anchor`` (hash), ``context`` (hash), ``first``, ``last``, ``left``, ``right``.

    Each string of ``length`` bytes has one anchor: its gram of least hash, the rightmost of
    equal ones. The strings that start from ``first`` to ``last`` of a text are those of one
    anchor; equal strings have equal anchors at equal offsets. The context is the bytes that
    those strings cover, with the anchor's offset in it. ``left`` and ``right`` are hashes of
    the half string that ends, or starts, with the anchor; 0 where the text is too short.
    """
    texts_at = [k for k, t in enumerate(texts) if len(t) >= length]
    if not texts_at:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in _COLUMNS})
    symbols = byte_symbols(np.frombuffer(b"".join(texts[k] for k in texts_at), dtype=np.uint8))
    sizes = np.array([len(texts[k]) for k in texts_at])
    of = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    anchor, context, first, last, left, right = _anchored(symbols, of, length, GRAM, 256, 0)
    begin, text = begins[of[first]], np.array(texts_at)[of[first]]
    return pd.DataFrame(dict(zip(_COLUMNS, (text, anchor, context, first - begin, last - begin, left, right), strict=True)))


def passage_anchors(texts: list[bytes], length: int = PASSAGE) -> pd.DataFrame:
    """``anchors`` of the runs of ``length`` words, in words, with the bytes from ``begin`` to ``stop`` that they cover."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, stop = words_of(data)
    of = np.searchsorted(ends, start, side="right")
    enough = np.bincount(of, minlength=len(texts)) >= length if len(of) else np.zeros(len(texts), dtype=bool)
    start, stop, of = start[enough[of]], stop[enough[of]], of[enough[of]]
    if not len(of):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in (*_COLUMNS, "begin", "stop")})
    anchor, context, first, last, left, right = _anchored(word_symbols(data, start, stop), of, length, PASSAGE_GRAM, 32, 0x5A5A_5A5A_5A5A_5A5A)
    text = of[first]
    word, byte = np.flatnonzero(np.diff(of, prepend=-1)), ends - [len(t) + 1 for t in texts]  # first word and byte of each text
    word = word[np.cumsum(np.diff(of, prepend=-1) != 0)[first] - 1]
    values = (text, anchor, context, first - word, last - word, left, right, start[first] - byte[text], stop[last + length - 1] - byte[text])
    return pd.DataFrame(dict(zip((*_COLUMNS, "begin", "stop"), values, strict=True)))


def _range_hashes(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, part: int) -> np.ndarray:
    """Hash of symbols[start:stop] for each pair, of ``part`` to four times as many: of the length
    and of the runs of ``part`` at both ends and next to them, which cover it."""
    h, size = run_hashes(symbols, part), stop - start
    out = _mix(h[start] * _M1 + h[stop - part])
    out = _mix(out * _M1 + h[np.minimum(start + part, stop - part)])
    out = _mix(out * _M1 + h[np.maximum(stop - 2 * part, start)])
    return _mix(out * _M1 + size.astype(np.uint64))


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of all suffixes by their first ``depth`` bytes, a power of two from 8 on."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    return refined(key, 8, depth)


def refined(key: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by the first ``depth`` symbols, where ``key`` orders suffixes by their first ``known``.

    Larsson-Sadakane refinement: suffixes are sorted by the key; then each group of equal
    ones is sorted by the rank of the suffix as many symbols on, doubling the depth, and a
    suffix alone in its group is never touched again. A rank is the group's last place.
    """
    n = len(key)
    order = np.argsort(key)
    head = np.ones(n, dtype=bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _last_of_group(head)
    h = known
    while h < depth:
        tail = np.append(head[1:], True)
        unsorted = np.flatnonzero(~(head & tail))
        if not len(unsorted):
            break
        suffix = order[unsorted]
        ahead = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1)
        both = (rank[suffix] << 32) | (ahead + 1)
        again = np.argsort(both)
        order[unsorted] = suffix[again]
        both = both[again]
        starts = np.ones(len(unsorted), dtype=bool)
        starts[1:] = both[1:] != both[:-1]
        head[unsorted] = starts
        rank[order] = _last_of_group(head)
        h *= 2
    return order, rank


def _last_of_group(head: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(head)
    stops = np.append(starts[1:], len(head))
    return np.repeat(stops - 1, stops - starts)


def common_prefixes(data: np.ndarray, order: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Kasai's array, capped: the common prefix of each suffix with the one before it in ``order``.

    Pairs start from the length ``known`` to be common (from the refinement), all at once,
    8 bytes a step, instead of one byte a time along the text; those done leave.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b = order[1:], order[:-1]
    lcp = known.copy()
    active = np.flatnonzero((lcp > 0) & (lcp < most))
    while len(active):
        i, j = a[active] + lcp[active], b[active] + lcp[active]
        same = words[np.minimum(i, n)] == words[np.minimum(j, n)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        lcp[active] = np.minimum(lcp[active] + run, most)
        active = active[(run == 8) & (lcp[active] < most)]
    return np.append(0, np.minimum(lcp, n - np.maximum(a, b)))


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, repeated, first) of every string of ``length`` in the contexts, by suffix array and common prefixes.

    ``first`` marks one of each set of equal strings. Strings are compared inside their
    contexts only.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(data)) + length <= ends[of]
    depth = 1 << ((length - 1).bit_length() - 1)  # the largest power of two below the length
    order, rank = suffix_ranks(data, depth)
    order = order[valid[order]]
    # of equal first `depth` bytes, those equal in the `depth` up to the length are neighbours
    both = (rank[order] << 32) | rank[order + length - depth]
    again = np.argsort(both)
    order, both = order[again], both[again]
    known = np.where(both[1:] == both[:-1], length, np.where(both[1:] >> 32 == both[:-1] >> 32, depth, 0))
    long = common_prefixes(data, order, known, length) >= length
    repeated, first = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    repeated[order[long]] = True
    repeated[order[np.flatnonzero(long) - 1]] = True
    first[order[~long]] = True
    at = np.flatnonzero(valid)
    return of[at], at - (ends - sizes)[of[at]], repeated[at], first[at]


def shared_passages(contexts: list[bytes], owners: np.ndarray, length: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, shared, first, hash) of every run of ``length`` words in the contexts, by their suffix array over words.

    A run is shared if contexts of two owners have it. ``first`` marks one of each set of
    shared ones, and all others.
    """
    data = np.frombuffer(b"\n".join(contexts) + b"\n", dtype=np.uint8)
    start, stop = words_of(data)
    of = np.searchsorted(np.cumsum([len(c) + 1 for c in contexts]), start, side="right")
    symbols = word_symbols(data, start, stop)
    hashes = run_hashes(symbols, length).view(np.int64)
    at = np.flatnonzero(of[: max(0, len(of) - length + 1)] == of[length - 1 :])
    depth = 1 << ((length - 1).bit_length() - 1)
    _, rank = refined(symbols, 1, depth)
    both = (rank[at] << 32) | rank[at + length - depth]
    again = np.argsort(both, kind="stable")
    head = np.ones(len(at), dtype=bool)
    head[1:] = both[again[1:]] != both[again[:-1]]
    group = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    mine = owners[of[at[again]]]
    apart = np.minimum.reduceat(mine, begin) != np.maximum.reduceat(mine, begin) if len(at) else np.zeros(0, dtype=bool)
    shared, first = np.empty(len(at), dtype=bool), np.empty(len(at), dtype=bool)
    shared[again] = apart[group]
    first[again] = head | ~apart[group]
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    return of[at], at - edge[of[at]], shared, first, hashes[at]


#: Bytes of text that one pass over a block of texts takes, so that its arrays stay in cache; a longer text is cut into overlapping blocks.
BLOCK = 1 << 16

_ANCHORS = "{id}, digest long, words boolean, anchor long, context long, first int, last int, begin int, stop int, left long, right long"
_CONTEXTS = "shard long, buckets long, words boolean, anchor long, context long, owner long, body binary"
#: A row for each context (``bucket`` null), and one for each salted anchor, shard and bucket with the shard's strings.
_REPEATS = (
    "anchor long, context long, spans array<struct<lo:int,hi:int>>, bucket long, contexts array<bigint>, owners array<bigint>, "
    "offsets array<int>, hashes array<bigint>, resolved array<boolean>"
)
_STRINGS = ["contexts", "owners", "offsets", "hashes", "resolved"]


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, offset, bytes) in blocks; every string of ``length`` is in exactly one piece."""
    block: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BLOCK):
            piece = text[at : at + BLOCK + length - 1]
            if size and size + len(piece) > BLOCK:
                yield block
                block, size = ([], [], []), 0
            for column, x in zip(block, (k, at, piece), strict=True):
                column.append(x)
            size += len(piece)
    if size:
        yield block


def _runs(at: np.ndarray) -> list[dict]:
    """Ascending numbers as runs {lo, hi}, both inclusive."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True)]


def _whole(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text, bytes) in blocks of whole texts."""
    which, size = [], 0
    for k, text in enumerate(texts):
        if which and size + len(text) > BLOCK:
            yield which, [texts[i] for i in which]
            which, size = [], 0
        which.append(k)
        size += len(text)
    if which:
        yield which, [texts[i] for i in which]


def _anchor_table(rows: DataFrame, id_type: str, length: int) -> DataFrame:
    columns = ["words", "anchor", "context", "first", "last", "begin", "stop", "left", "right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, found, rows = batch["body"].tolist(), [], []
            for which, offset, block in _blocks(texts, length):
                part = anchors(block, length)
                piece = part.pop("text").to_numpy()
                shift = np.array(offset)[piece]
                rows.append(np.array(which)[piece])
                found.append(part.assign(words=False, first=part["first"] + shift, last=part["last"] + shift, begin=0, stop=0))
            for which, block in _whole(texts):
                part = passage_anchors(block)
                rows.append(np.array(which)[part.pop("text").to_numpy()])
                found.append(part.assign(words=True))
            if found:
                own = batch.iloc[np.concatenate(rows)][["doc_id", "digest"]].reset_index(drop=True)
                yield own.join(pd.concat(found, ignore_index=True)[columns])

    return rows.mapInPandas(lean(run), _ANCHORS.format(id=f"doc_id {id_type}"))


def _cut_contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted context, cut from the text chosen to give it.

    Rows that repeat an id and its text each give their contexts; all strings of those are
    repeats anyway.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (x["shard"], x["buckets"], x["words"], x["anchor"], x["context"], x["owner"], body[x["begin"] : x["stop"]])
                for body, cuts in zip(batch["body"], batch["cuts"], strict=True)
                for x in cuts
            ]
            yield pd.DataFrame(out, columns=["shard", "buckets", "words", "anchor", "context", "owner", "body"])

    fields = ["shard", "buckets", "words", "anchor", "context", "owner", "begin", "stop"]
    cuts = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*fields)).alias("cuts"))
    keys = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("digest") == F.col("_digest")]
    cuts = cuts.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    return rows.join(cuts, keys).select("body", "cuts").mapInPandas(lean(run), _CONTEXTS)


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Per context, the strings that its shard holds twice; of salted anchors, one of each set of equal strings for other shards."""

    def of_kind(pdf: pd.DataFrame, words: bool) -> Iterator[pd.DataFrame]:
        pdf = pdf[pdf["words"] == words].sort_values(["anchor", "context"], ignore_index=True)
        if not len(pdf):
            return
        bodies, owners = pdf["body"].tolist(), pdf["owner"].to_numpy()
        if words:
            context, offset, repeated, first, hashes = shared_passages(bodies, owners)
        else:
            context, offset, repeated, first = repeated_starts(bodies, length)
        edges = np.searchsorted(context, np.arange(len(bodies) + 1))
        spans = [_runs(offset[a:b][repeated[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pdf[["anchor", "context"]].assign(spans=spans, **dict.fromkeys(["bucket", *_STRINGS]))
        for anchor, members in pdf.groupby("anchor").indices.items():
            if not pdf["buckets"][members[0]]:
                continue
            first_of, last_of = int(members[0]), int(members[-1]) + 1
            a, b = edges[first_of], edges[last_of]
            at = np.arange(a, b)[first[a:b]]
            codes = hashes[at] if words else np.concatenate([_codes(bodies[k], length, offset[i:j][first[i:j]]) for k, i, j in zip(members, edges[members], edges[members + 1], strict=True)])
            columns = pdf["context"].to_numpy()[context[at]], owners[context[at]], offset[at].astype(np.int32), codes, repeated[at]
            bucket = (codes.view(np.uint64) % np.uint64(pdf["buckets"][first_of])).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            parts = [np.split(c[order], cuts[1:]) for c in columns]
            dealt = pd.DataFrame({"anchor": anchor, "bucket": bucket[order][cuts], **dict(zip(_STRINGS, parts, strict=True))})
            yield dealt.assign(context=None, spans=None).astype({"bucket": object})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [x.astype({"context": object}) for words in (False, True) for x in of_kind(pdf, words)]
        return pd.concat(parts, ignore_index=True)[["anchor", "context", "spans", "bucket", *_STRINGS]]

    return contexts.groupBy("shard").applyInPandas(run, _REPEATS)


def _codes(body: bytes, length: int, at: np.ndarray) -> np.ndarray:
    return run_hashes(byte_symbols(np.frombuffer(body, dtype=np.uint8)), length).view(np.int64)[at]


def _merge_shards(found: DataFrame) -> DataFrame:
    """Strings of salted contexts that another shard has too: (anchor, context, spans).

    Each shard gives each of its strings once, dealt by hash into buckets of about ``BUCKET``
    for each anchor, a row for a bucket. There a string that its own shard has only once is
    looked for among the sorted strings of all shards by binary search.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        context, owner, at, code, resolved = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in _STRINGS)
        order = np.lexsort((owner, code))
        context, owner, at, code, resolved = (x[order] for x in (context, owner, at, code, resolved))
        left, right = np.searchsorted(code, code, side="left"), np.searchsorted(code, code, side="right")
        twice = (owner[left] != owner[right - 1]) & ~resolved.astype(bool)
        met = pd.DataFrame({"context": context[twice], "at": at[twice]})
        out = [(pdf["anchor"].iloc[0], name, _runs(np.sort(part.to_numpy()))) for name, part in met.groupby("context")["at"]]
        return pd.DataFrame(out, columns=["anchor", "context", "spans"])

    strings = found.where("bucket is not null").select("anchor", "bucket", *_STRINGS)
    return strings.groupBy("anchor", "bucket").applyInPandas(run, "anchor long, context long, spans array<struct<lo:int,hi:int>>")


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` (doc_id, digest, body), and per (doc_id, digest) the runs of starts
    of repeated strings, in bytes, and of passages that another document has too, in words."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("body"))
    spark = docs.sparkSession
    with arrow_rows(spark, 1024):
        every = materialise(_anchor_table(rows, rows.schema["doc_id"].dataType.simpleString(), length), "suffix-anchors")
    # most anchors occur once and leave here; both sides are written, so that Spark can split a hot anchor's rows
    often = materialise(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select(F.col("anchor").alias("_a")), "suffix-often")
    table = materialise(every.join(often.hint("merge"), F.col("anchor") == F.col("_a")).drop("_a"), "suffix-held")
    release(every, often)
    # a passage must be in two documents, a string may be twice in one
    holder = F.struct("doc_id", "digest")
    times = F.when(~F.bool_or("words"), F.count(F.lit(1))).when(F.min(holder) != F.max(holder), F.lit(2)).otherwise(F.lit(1))
    contexts = table.groupBy("anchor", "context").agg(
        times.cast("long").alias("n"), F.min(F.struct("doc_id", "digest", "words", "first", "last", "begin", "stop", "left", "right")).alias("where")
    )
    contexts = materialise(contexts.select("anchor", "context", "n", "where.*"), "suffix-contexts")
    # a string with a twin shares half of it, on one side of the anchor at least; written, so
    # that Spark can split the joins on the halves that very many contexts share
    halves = contexts.select("n", F.explode(F.array("left", "right")).alias("half")).where("half <> 0")
    shared = materialise(halves.groupBy("half").agg(F.sum("n").alias("m")).where("m > 1").select("half"), "suffix-halves")
    for side in ("left", "right"):
        # a context too short on this side looks for itself, so that such don't meet in one task
        key = F.when(F.col(side) != 0, F.col(side)).otherwise(F.col("context"))
        found = shared.select(F.col("half").alias("_h"), F.lit(True).alias(f"on_{side}"))
        contexts = contexts.withColumn("_k", key).join(found, F.col("_k") == F.col("_h"), "left").drop("_h", "_k")
    begin, stop = (F.when(F.col("words"), F.col(a)).otherwise(b).alias(a) for a, b in (("begin", F.col("first")), ("stop", F.col("last") + length)))
    twins = materialise(contexts.where("on_left or on_right").select("anchor", "context", "n", "doc_id", "digest", "words", "first", "last", begin, stop), "suffix-twins")
    kinds = materialise(twins.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "suffix-kinds")
    contexts = twins.join(kinds, "anchor")
    mixed = contexts.where("kinds > 1")
    size, salted = mixed.agg(F.sum(F.col("stop") - F.col("begin")), F.max("kinds")).first()
    shards = max(1, -(-(size or 0) // SHARD))
    salt = F.when(F.col("kinds") > HOT, F.pmod("context", F.ceil(F.col("kinds") / HOT))).otherwise(F.lit(0))
    owner = F.when(F.col("words") & (F.col("n") == 1), F.xxhash64("doc_id", "digest")).otherwise(F.col("context"))
    wanted = mixed.select(
        "doc_id",
        "digest",
        "words",
        "begin",
        "stop",
        "anchor",
        "context",
        owner.alias("owner"),
        F.when(F.col("kinds") > HOT, F.ceil(F.col("kinds") * length / BUCKET)).otherwise(F.lit(0)).cast("long").alias("buckets"),
        F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard"),
    )
    found = _repeats(_cut_contexts(rows, wanted), length)
    if (salted or 0) > HOT:
        with arrow_rows(spark, 1024):
            found = materialise(found, "suffix-found")
        found = found.where("bucket is null").select("anchor", "context", "spans").unionByName(_merge_shards(found))
    copies = F.array(F.struct(F.lit(0).alias("lo"), (F.col("last") - F.col("first")).cast("int").alias("hi")))
    within = found.where(F.size("spans") > 0).select("anchor", "context", "spans")
    within = within.unionByName(contexts.where("n > 1").select("anchor", "context", copies.alias("spans")))
    starts = table.join(within, ["anchor", "context"]).select("doc_id", "digest", "words", "first", F.explode("spans").alias("x"))
    starts = starts.select("doc_id", "digest", "words", F.struct((F.col("first") + F.col("x.lo")).alias("lo"), (F.col("first") + F.col("x.hi")).alias("hi")).alias("x"))
    parts = [F.collect_set(F.when(of, F.col("x"))).alias(name) for of, name in ((~F.col("words"), "starts"), (F.col("words"), "passages"))]
    return rows, starts.groupBy("doc_id", "digest").agg(*parts)


def _covered(found, length: int) -> list[list[int]]:
    """The maximal runs that strings of ``length`` cover, from the runs {lo, hi} of their starts; ends exclusive."""
    spans: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in (found if found is not None else ())):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (removed runs, end exclusive), ``kept`` (the bytes left), ``passages``.

    A byte goes if a string of ``length`` UTF-8 bytes that covers it also starts anywhere
    else in any text, its own included; overlapping repeats count, and strings are judged on
    the input. Strings never run from one document into another.

    ``passages`` are the maximal runs of words (numbered in the text, end exclusive) covered
    by runs of ``PASSAGE`` words that another document has too, however few bytes those are;
    nothing is removed for them. Words are divided by ASCII white space and control characters.

    Edge cases: null text counts as empty; texts shorter than ``length`` lose nothing; rows
    with equal texts, repeated rows and rows with null ids included, are repeats of each
    other, but rows of one id (or none) and one text share passages with others only; an
    empty table gives an empty result; other columns are ignored.
    """
    rows, starts = repeated_spans(docs, id_col, text_col, length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, body, found, shared in zip(batch["doc_id"], batch["body"], batch["starts"], batch["passages"], strict=True):
                spans, passages = _covered(found, length), _covered(shared, PASSAGE)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(body[at:lo])
                    at = hi
                kept.append(body[at:])
                out.append((doc_id, len(body), *([{"start": a, "end": b} for a, b in x] for x in (spans, passages)), b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "passages", "kept"])

    starts = starts.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    joined = rows.join(starts, [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("digest") == F.col("_digest")], "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:int,end:int>>"
    small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, n_bytes long, spans {span}, passages {span}, kept binary"
    return joined.select("doc_id", "body", "starts", "passages").mapInPandas(lean(run), schema)
