"""Near-duplicate join on word shingles with Bayesian candidate pruning."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.components import components
from stratamem.llm.shared import arrow_rows, fresh, lean, materialise

WORDS = 5
THRESHOLD = 0.8
#: MinHash values of a text: BANDS bands of ROWS. A pair at the threshold shares a band with
#: probability 1 - (1 - 0.8^6)^42, all but three in a million.
BANDS, ROWS = 42, 6
#: Values compared before each pruning step.
STEP = 8
#: A pair is dropped once its probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Distinct texts, and characters, of a block; a larger cluster is compared block by block.
BLOCK, BLOCK_CHARS = 512, 8_000_000
#: Characters of the texts that one task compares, about.
SHARD_CHARS = 4_000_000

_WORD = re.compile(r"\w+")


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class _Codes(dict):
    """Word -> 64-bit hash, with a memo that starts anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``WORDS`` words; a shorter text is one run; no words, none."""
    codes = np.array([_codes[w] for w in _WORD.findall(text.lower())], dtype=np.uint64)
    if not len(codes):
        return codes
    factor = np.uint64(0x9E3779B97F4A7C15)
    if len(codes) < WORDS:
        h = np.uint64(len(codes))
        for c in codes:
            h = np.uint64((int(h) * int(factor) + int(c)) & (1 << 64) - 1)
        h = np.array([h])
    else:
        h = codes[: len(codes) - WORDS + 1]
        for j in range(1, WORDS):
            h = h * factor + codes[j : len(codes) - WORDS + 1 + j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, as unsigned 32-bit numbers."""
    a, b = _factors()
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for i in range(0, len(found), 256):  # blocks that stay in cache
        np.minimum(least, (found[i : i + 256, None] * a + b).min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    return (least * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]) + np.uint64(1)
    for j in range(ROWS):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (s[:, :, j] + (h >> np.uint64(29)))
        h = h * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


@lru_cache(maxsize=1)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed) at each step.

    With a uniform prior, m matches of n values leave the similarity at or above t with
    probability P(Bin(n + 1, t) <= m); fewer matches than needed put it below the tolerance.
    """
    steps = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        steps.append((n, m))
    return tuple(steps)


def prune(signatures: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs (rows ``left`` and ``right`` of the signatures) may still reach the threshold."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int32), 0
    for n, needed in least_matches():
        matches = matches + (signatures[left[alive], done:n] == signatures[right[alive], done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= needed
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    return alive


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``THRESHOLD`` or more, exactly.

    Few pairs are intersected one by one; many share the work, as products of a 0/1 matrix
    over the hashes that at least two of the sets have, a slice of columns at a time.
    """
    sizes = np.array([len(s) for s in sets])
    if len(left) <= 8 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    else:
        which = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        which, column = which[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        which, column = which[order], column[order]
        product = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for first in range(0, int(number[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[which[a:b], column[a:b] - first] = 1
            product += part @ part.T
        common = product[left, right].astype(np.int64)
    return common >= THRESHOLD * (sizes[left] + sizes[right] - common) - 1e-9


def links_of(texts: list[str], block: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of the texts: all pairs, or (``within`` false) those across two blocks."""
    sets = [shingles(t) for t in texts]
    signatures = np.array([signature(s) for s in sets])
    out = []
    for a in range(len(texts)):  # a row of pairs at a time
        others = np.arange(a + 1, len(texts))
        if not within:
            others = others[block[others] != block[a]]
        if len(others):
            out.append(others[prune(signatures, np.full(len(others), a), others)])
        else:
            out.append(others)
    left = np.repeat(np.arange(len(texts)), [len(x) for x in out])
    right = np.concatenate(out) if out else left
    good = verified(sets, left, right) if len(left) else np.zeros(0, dtype=bool)
    return left[good], right[good]


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    parent = np.arange(count)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(count)])


def _compare(members: DataFrame, id_type: str) -> DataFrame:
    """(rep, links, root) for each text of each group of blocks: documents it is linked to, least text it is linked with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), group in pdf.groupby(["component", "i", "j"]):
            group = group.drop_duplicates(["rep", "own"]).sort_values(["rep", "own"], ignore_index=True)
            left, right = links_of(group["text"].tolist(), group["block"].to_numpy(), i == j)
            copies = group["copies"].to_numpy()
            links = np.bincount(left, copies[right], len(group)) + np.bincount(right, copies[left], len(group))
            root = group["rep"].to_numpy()[_roots(len(group), left, right)]
            out.append(pd.DataFrame({"rep": group["rep"], "links": links.astype(np.int64), "root": root, "blocks": group["blocks"]}))
        return pd.concat(out)

    return members.groupBy("shard").applyInPandas(run, f"rep {id_type}, links long, root {id_type}, blocks long")


def _described(rows: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, code, text in zip(batch["doc_id"], batch["code"], batch["text"], strict=True):
                found = shingles(text)
                if len(found):
                    digest = xxhash.xxh3_128_intdigest(found.tobytes())
                    high, low = ((digest >> k & (1 << 64) - 1) - (1 << 63) for k in (64, 0))
                    out.append((doc_id, code, high, low, len(text), band_keys(signature(found)[None])[0]))
                else:
                    out.append((doc_id, code, None, None, len(text), None))
            made = pd.DataFrame(out, columns=["doc_id", "code", "high", "low", "chars", "bands"])
            yield made.astype({"high": "Int64", "low": "Int64"})

    return rows.mapInPandas(lean(run), f"doc_id {id_type}, code long, high long, low long, chars long, bands array<bigint>")


def _hub_links(met: DataFrame) -> DataFrame:
    """(a, b) that connect all texts (rep) with all their hubs: at most one link a text, and those among hubs."""
    hubs = met.groupBy("rep").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs"))  # a hub a band at most
    own = hubs.select(F.col("rep").alias("a"), F.col("least").alias("b"))
    among = hubs.select(F.explode("hubs").alias("a"), F.col("least").alias("b"))
    return own.unionByName(among).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``class_id`` and ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is
    ``THRESHOLD`` or more; ``n_links`` counts the documents linked to this one, and
    ``class_id`` is the least id that links lead to.

    Documents of one shingle set are one text with copies. Texts that share a band of
    MinHash values are joined into clusters through the least text of each bucket, its hub:
    a text is linked to the least of its hubs, and its other hubs to that one, each pair of
    hubs once; so the links follow the texts, not texts times bands. The texts of a cluster meet in one task, or in blocks
    of ``BLOCK``, two by two, if there are many; no pair becomes a row. A task compares
    MinHash values step by step and drops pairs whose posterior falls below ``TOLERANCE``,
    and verifies the others on their full sets; what it returns is linear in its texts.

    Edge cases: null text counts as empty; a text without words has no links and is its own
    class, copies included; one of fewer than ``WORDS`` words is one shingle; rows that
    repeat an id are documents of their own with one class; rows with null ids have a null
    class and no links; an empty table gives an empty result; other columns are ignored.
    """
    return _classified(docs, id_col, text_col).drop("code")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with ``code``, the hash of each row's text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("code"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with arrow_rows(spark, 1024):
        described = materialise(_described(rows, kind), "jaccard-rows")
    named = described.where("doc_id is not null and high is not null")
    least = F.min(F.struct("doc_id", "code")).alias("least")
    sets = named.groupBy("high", "low").agg(least, F.count(F.lit(1)).alias("copies"), F.max("chars").alias("chars"))
    sets = materialise(sets.select("high", "low", F.col("least.doc_id").alias("rep"), F.col("least.code").alias("own"), "copies", "chars"), "jaccard-sets")
    texts = sets.select("rep", "own").hint("merge")
    banded = named.join(texts, (F.col("doc_id") == F.col("rep")) & (F.col("code") == F.col("own")))
    banded = banded.select("rep", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub != top").select("key", "hub").hint("merge")
    clusters = components(_hub_links(banded.join(hubs, "key").select("rep", "hub")))
    members = clusters.join(sets, F.col("node") == F.col("rep")).select("rep", "own", "component", "copies", "chars")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_CHARS))
    members = members.join(sizes.select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    members = members.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k")
    members = materialise(members, "jaccard-members")
    total = members.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    members = members.withColumn("shard", F.pmod(F.xxhash64("component", "i", "j"), F.lit(shards)))
    # texts meet their places by sort-merge at every size, as the members grow with the rows
    whole = rows.join(members.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("code") == F.col("own")))
    whole = whole.select("rep", "own", "text", "component", "i", "j", "block", "blocks", "copies", "shard")
    compared = materialise(_compare(whole, kind), "jaccard-links")
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    if compared.where("blocks > 1").limit(1).count():
        joined = components(compared.where("blocks > 1").select(F.col("rep").alias("a"), F.col("root").alias("b")))
        joined = joined.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        links = links.join(joined, F.col("rep") == F.col("_n"), "left").withColumn("root", F.coalesce("_c", "root"))
    links = links.select(F.col("rep").alias("_r"), "links", "root")
    classes = sets.join(links, F.col("rep") == F.col("_r"), "left").select(
        F.col("high").alias("_high"), F.col("low").alias("_low"), F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = described.join(classes, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")), "left")
    unnamed = F.col("doc_id").isNull()
    return out.select(
        "doc_id",
        "code",
        F.when(~unnamed, F.coalesce("root", "doc_id")).alias("class_id"),
        F.when(unnamed, F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their class, with all columns: one document of each class.

    Edge cases as in ``near_duplicates``; rows with null ids stay, and so do rows that repeat
    an id and its text. ``one_of_each`` leaves one row of each class.
    """
    key, code = fresh("kept"), fresh("code")
    kept = _classified(docs, id_col, text_col).where("doc_id is null or doc_id = class_id")
    kept = kept.select(F.col("doc_id").alias(key), F.col("code").alias(code)).distinct()
    mine = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(code)
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & mine, "left_semi")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of near copies, with all its columns: that of the least id, nulls last.

    Every row is a document of its own here, under a key that is written with it, so neither
    null ids nor ids that repeat hide copies or tie texts together. A row without words stays.
    """
    key, doc_id, kept = fresh("key"), fresh("id"), fresh("kept")
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "jaccard-keyed")
    classes = near_duplicates(keyed, key, text_col).select(F.col("doc_id").alias(kept), "class_id")
    named = classes.join(keyed.select(key, F.col(id_col).alias(doc_id)).hint("merge"), F.col(kept) == F.col(key))
    least = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(kept).alias("key")))
    firsts = named.groupBy("class_id").agg(least.alias("least")).select(F.col("least.key").alias(kept))
    return keyed.join(firsts, F.col(key) == F.col(kept), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
