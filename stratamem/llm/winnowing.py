"""Document fingerprints by winnowing, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.shared import bind, materialise, with_before

#: Tokens of a k-gram.
K = 5
#: k-grams of a window (a power of two); a shared run of K + WINDOW - 1 tokens is always found.
WINDOW = 8

#: A word of up to 24 letters and digits is a token, and so is any other character but white
#: space: characters of punctuation, of longer runs, and of scripts without spaces.
TOKEN = (
    r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{1,24}+"
    r"(?![\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]])|\S"
)

PRIME = (1 << 31) - 1
BASE = 1_000_003
_LOW = (1 << 32) - 1


def kgram_hashes(tokens: Column, k: int = K) -> Column:
    """The rolling hash of each run of ``k`` tokens: a polynomial modulo a prime, by Horner's rule.

    One pass per term over aligned slices of the token hashes. Fewer than ``k`` tokens are
    one gram; none give none.
    """

    def grams(codes: Column) -> Column:
        count = F.size(codes) - (k - 1)
        whole = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * BASE + c) % PRIME)
        rolled = F.slice(codes, F.lit(1), count)
        for j in range(1, k):
            rolled = F.zip_with(rolled, F.slice(codes, F.lit(j + 1), count), lambda h, c: (h * BASE + c) % PRIME)
        return F.when(count > 0, rolled).when(F.size(codes) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))), grams)


def winnow(grams: Column, window: int = WINDOW) -> Column:
    """The selected k-grams, each as hash << 32 | (2^32 - 1 - position), by position.

    Of each window the least hash is kept, the rightmost of equal ones; packed this way the
    least number is that one. The minimum over a window comes from windows of half its
    size, doubling from 1. Fewer grams than a window are one window.
    """

    def select(packed: Column) -> Column:
        least, width = packed, 1
        while width < window:
            left = F.size(packed) - (2 * width - 1)
            least = _halves(least, left, width)
            width *= 2
        return F.when(F.size(packed) >= window, F.array_distinct(least)).when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)

    mixed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(h), 33), 32) + (F.lit(_LOW) - i))
    return bind(mixed, select)


def _halves(least: Column, left: Column, width: int) -> Column:
    some = F.greatest(left, F.lit(0))
    return bind(least, lambda x: F.zip_with(F.slice(x, F.lit(1), some), F.slice(x, F.lit(width + 1), some), lambda a, b: F.least(a, b)))


def fingerprint(text: Column) -> Column:
    """``array<bigint>`` of the selected k-grams of a text, as ``winnow`` packs them."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return winnow(kgram_hashes(tokens))


def hashes(prints: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32).cast("int")))


def as_string(prints: Column) -> Column:
    """``hash:position`` (hash in hexadecimal, position in tokens), comma-joined."""
    return F.array_join(
        F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(_LOW)).cast("string"))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard resemblance of two arrays of distinct hashes; 1 if both are empty."""

    def ratio(both: Column) -> Column:
        return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))

    return bind(F.size(F.array_intersect(a, b)), ratio)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_chars`` and ``prints`` (see ``winnow``).

    Edge cases: null text counts as empty; a text without tokens has no prints; one of
    fewer tokens than a k-gram has one print of all; null ids pass through; other columns
    are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("prints"))


#: Rows of a range of ids, about; heads that a row is compared with on each of two levels.
RANGE_ROWS, FAN = 512, 1024


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) with ``range``, ``guest`` and ``first`` (the least id of all), by ranges of distinct ids of equal count.

    Only ids are sorted. What the rows are told is the least id of each range, in two
    levels: up to ``FAN`` of them as literals, and below each as many in a broadcast table
    of at most ``FAN`` squared ids, some MB. A range has ``RANGE_ROWS`` ids as long as that
    makes no more ranges, a million, and then more ids. The head of a range is in the range
    before it too, as a guest, so that the last row there can look ahead; the first head of
    all is a guest of the last range.
    """
    ids = rows.select("doc_id").distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = materialise(with_before(ids, ["doc_id"], {"place": "_one"}, "winnow-ids"), "winnow-places")
    count = ranked.count()
    width = max(RANGE_ROWS, -(-count // (FAN * FAN)))
    ranges = max(1, -(-count // width))
    heads = materialise(ranked.where(F.col("place") % width == 0).select("doc_id", F.floor(F.col("place") / width).alias("range")), "winnow-heads")
    top = [r["doc_id"] for r in heads.where(F.col("range") % FAN == 0).orderBy("range").collect()]  # FAN at most
    below = heads.groupBy(F.floor(F.col("range") / FAN).alias("_k")).agg(F.array_sort(F.collect_list("doc_id")).alias("_heads"))
    kind = rows.schema["doc_id"].dataType
    met = _under(rows.withColumn("_k", _last_of(F.array(*(F.lit(h) for h in top)).cast(f"array<{kind.simpleString()}>"))), below)
    own = F.col("_k") * FAN + _last_of(F.col("_heads"))
    before = F.pmod(own - 1 + ranges, F.lit(ranges))
    home, away = (F.struct(r.alias("range"), F.lit(g).alias("guest")) for r, g in ((own, False), (before, True)))
    places = F.when(F.array_contains("_heads", F.col("doc_id")), F.array(home, away)).otherwise(F.array(home))
    dealt = met.withColumn("_place", F.explode(places)).select(*rows.columns, "_place.*", F.lit(top[0] if top else None).cast(kind).alias("first"))
    tasks = max(ranges // 8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # several ranges a task even them out
    return dealt.repartition(tasks, "range")


def _last_of(heads: Column) -> Column:
    """Which of the sorted heads is the last that isn't above the id, from 0."""
    return F.size(F.filter(heads, lambda h: h <= F.col("doc_id"))).cast("long") - 1


def _under(rows: DataFrame, below: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(materialise(below, "winnow-below").withColumnRenamed("_k", "_b")), F.col("_k") == F.col("_b"))


def with_next(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` (doc_id, text) with columns computed from each row and, as ``next_<name>``, those and the text of the row after it by ``doc_id``.

    The last row's next is the first. Texts move once, to their ranges.
    """
    dealt = in_ranges(rows).withColumns(columns)
    # the first id of all comes last where it is a guest
    order = Window.partitionBy("range").orderBy(F.col("guest") & (F.col("doc_id") == F.col("first")), "doc_id", "text", "guest")
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *columns)})
    return ahead.where(~F.col("guest")).drop("range", "guest", "first")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down) replaced by the start of ``following``."""
    tail = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (F.length(text) - tail).cast("int")), F.substring(following, F.lit(1), tail))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text, and how alike they and the next one's are.

    Columns ``doc_id``, ``n_chars``, ``edited_sha256``, ``prints``, ``edited_prints``,
    ``near_edited``, ``near_next``. Texts move once, to ranges of ids.

    Edge cases: as in ``fingerprints``; a table of one row is its own next; rows that share
    an id follow each other by text; a null id has no next document (an empty one stands in).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    own = {"prints": fingerprint(F.col("text"))}
    named = with_next(rows.where("doc_id is not null"), own)
    empty = F.array().cast("array<bigint>")
    unnamed = rows.where("doc_id is null").withColumns({**own, "next_text": F.lit(""), "next_prints": empty})
    met = named.unionByName(unnamed).select(
        "doc_id",
        "prints",
        F.length("text").cast("long").alias("n_chars"),
        edited(F.col("text"), F.col("next_text")).alias("edited"),
        hashes(F.col("next_prints")).alias("next_hashes"),
    )

    def compared(own: Column) -> Column:
        return bind(
            fingerprint(F.col("edited")),
            lambda e: F.struct(e.alias("edited_prints"), likeness(own, hashes(e)).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next")),
        )

    return met.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "prints", bind(hashes(F.col("prints")), compared).alias("x")
    ).select("doc_id", "n_chars", "edited_sha256", "prints", "x.edited_prints", "x.near_edited", "x.near_next")
