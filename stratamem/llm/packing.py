"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.llm.segments import NO_SPACE, Memo, load, lowered
from stratamem.llm.shared import arrow_rows, lean, materialise

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together.
SHARD = 16_384
#: A sequence emptier than this share is taken apart, and its pieces packed again with others such.
FULL = 0.995


@lru_cache(maxsize=4)
def _memo(path: str) -> Memo:
    return Memo(load(path), lambda ids: struct.pack(f"<{len(ids)}I", *ids), lower=True)


def ids_batch(path: str, texts: list[str]) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    ids_of = _memo(path).__getitem__
    return [b"".join(map(ids_of, NO_SPACE.findall(lowered(t)))) for t in texts]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The tokenised documents, cut where longer than ``capacity``: a written table.

    Columns: ``row`` (a number of the row of ``docs``), ``doc_id``, ``piece``, ``start``,
    ``length`` and ``ids`` (binary, little-endian unsigned 32-bit).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, end = 4 * capacity, struct.pack("<I", END_ID)
        for batch in batches:
            texts = batch["text"].tolist()
            for i in range(0, len(texts), 256):
                out = []
                for row, doc_id, ids in zip(batch["row"][i : i + 256], batch["doc_id"][i : i + 256], ids_batch(tokenizer_path, texts[i : i + 256]), strict=True):
                    ids += end
                    out += [(row, doc_id, n, n * capacity, len(part := ids[k : k + step]) // 4, part) for n, k in enumerate(range(0, len(ids), step))]
                yield pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.mapInPandas(lean(run), "row long, doc_id string, piece int, start long, length long, ids binary")
    cut = cut.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    with arrow_rows(docs.sparkSession, 1024):
        return materialise(cut, "pack-pieces")


class Pool:
    """Lengths not packed yet, as counts and a bit set."""

    def __init__(self, lengths: list[int], capacity: int):
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for k in range(len(lengths) - 1, -1, -1):
            self.items[lengths[k]].append(k)
        self.bits = sum(1 << n for n, x in enumerate(self.items) if x)

    def largest(self, most: int) -> int:
        """The largest length up to ``most``; -1 if none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1

    def take(self, length: int) -> int:
        """An item of that length, first come first."""
        k = self.items[length].pop()
        if not self.items[length]:
            self.bits ^= 1 << length
        return k

    def give(self, length: int, k: int) -> None:
        """Put an item back."""
        self.items[length].append(k)
        self.bits |= 1 << length

    def two(self, gap: int, more: int) -> tuple[int, int] | None:
        """Two lengths that fill ``gap`` best, by more than ``more`` together."""
        best, found = more, None
        a = self.largest(gap - 1)
        while a > 0 and 2 * a > best:
            b = self.largest(min(a, gap - a))
            if b == a and len(self.items[a]) < 2:
                b = self.largest(a - 1) if a > 1 else -1
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1) if a > 1 else -1
        return found


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths``, by best-two-fit.

    A sequence takes the longest item left, then again and again the longest that fits.
    If a gap is left, its smallest item gives way to the two items left that fill the gap
    and its place best, if they fill more than it did.
    """
    pool, sequences = Pool(lengths, capacity), []
    while (n := pool.largest(capacity)) > 0:
        inside, gap = [], capacity
        while n > 0:
            inside.append((n, pool.take(n)))
            gap -= n
            n = pool.largest(gap) if gap else -1
        if gap:
            small, k = inside[-1]
            if len(inside) > 1 and (pair := pool.two(gap + small, small)):
                inside.pop()
                inside += [(x, pool.take(x)) for x in pair]
                pool.give(small, k)
        sequences.append([k for _, k in inside])
    return sequences


def _pack_shards(items: DataFrame, count: int, level: int, capacity: int) -> DataFrame:
    """(row, piece, sequence_id, offset, fill) of items (row, piece, length), packed in shards dealt by hash."""
    shards = max(1, -(-count // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        lengths, shard, out = pdf["length"].tolist(), int(pdf["shard"].iloc[0]), []
        for n, inside in enumerate(pack_lengths(lengths, capacity)):
            offset, fill = 0, sum(lengths[k] for k in inside)
            for k in inside:
                out.append((k, (level << 56) | (shard << 28) | n, offset, fill))
                offset += lengths[k]
        found = pd.DataFrame(out, columns=["k", "sequence_id", "offset", "fill"])
        return pdf.loc[found["k"], ["row", "piece", "length"]].reset_index(drop=True).join(found[["sequence_id", "offset", "fill"]])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "row long, piece int, length long, sequence_id long, offset long, fill long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, piece, sequence_id, offset) of the table ``pieces`` makes.

    Pieces as long as a sequence are one each. The others are dealt by hash into shards of
    about ``SHARD``, packed in a task each; what ends in sequences less than ``FULL`` is
    gathered from all shards, dealt into fewer and packed again.
    """
    items = cut.select("row", "piece", "length")
    whole = items.where(F.col("length") == capacity).select(
        "row", "piece", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = items.where(F.col("length") < capacity)
    first = materialise(_pack_shards(rest, rest.count(), 1, capacity), "pack-first")
    good = F.col("fill") >= int(capacity * FULL)
    again = first.where(~good).select("row", "piece", "length")
    second = _pack_shards(again, again.count(), 2, capacity)
    packed = first.where(good).unionByName(second).select("row", "piece", "sequence_id", "offset")
    return packed.unionByName(whole)


def placed(cut: DataFrame, where: DataFrame) -> DataFrame:
    """The pieces with their places."""
    return cut.join(where, ["row", "piece"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id``, ``offset``.

    A document is its ids by the library, without added special tokens, then ``END_ID``.

    Edge cases: null text counts as empty, a piece of one id; repeated rows are packed each;
    null ids pass through; equal lengths are taken in the order of rows; an empty table
    gives an empty result; other columns are ignored.
    """
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity)
    return placed(cut, place(cut, capacity)).drop("row")
