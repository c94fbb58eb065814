"""Exact dedup by skew-safe combining: local, then salted, then global, on full content throughout."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.llm.shared import fresh, materialise

#: Tasks over which the copies of one text are spread; one bit each of a long.
SALTS = 64


def normalised(text: Column) -> Column:
    """A null text as the empty one, with A-Z alone lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are equal when their texts are, after ``normalised``; the largest id of a group stays.

    Three rounds of combining, each keyed by the whole text beside its digest, so a digest
    collision can never merge two texts:

    1. map-side, inside each input partition;
    2. per (digest, salt): a group that holds a third of all rows is met by ``SALTS`` tasks;
    3. per digest, over at most ``SALTS`` winners of each group.

    Rows then find their group by (digest, salt) without their texts, which keeps a hot
    group spread over ``SALTS`` tasks on the way back too. Should a digest ever hold two
    texts, the job stops with an error rather than merge them.

    Edge cases: null text counts as empty; null ids sort below every id, and a group of
    null ids alone keeps all its rows (``keep_id`` null); rows that repeat an id and its
    text can't be told apart and share one verdict; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content")).select(
        "doc_id",
        "content",
        F.sha2("content", 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "content").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(_bit("salt")).alias("salts")
    )
    by_digest = whole.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.bit_or("salts").alias("salts"),
    )
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col("salts").bitwiseAND(_bit(s)) != 0)
    winners = by_digest.select(
        "digest",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("group_size"),
        "keep_id",
        F.explode(used).alias("salt"),
    )
    found = rows.select("doc_id", "digest", "salt").join(winners, ["digest", "salt"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _bit(n) -> Column:
    return F.expr("shiftleft(1L, salt)") if isinstance(n, str) else F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose verdict is ``kept``, with all their columns.

    Edge cases as in ``assign_groups``: rows that repeat an id and its text all stay, and so
    does a group of null ids alone. ``one_of_each`` leaves one row of each text.
    """
    key, digest = fresh("kept"), fresh("digest")
    kept = assign_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & (_digest(F.col(text_col)) == F.col(digest)), "left_semi")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: that of the largest id, nulls last.

    Rows that repeat an id and its text, and rows of a group of null ids alone, come down to the
    first by their JSON; each input partition passes on one of them. Only ids and digests say
    which rows these are, and a table without such rows is not read for them.
    """
    key, digest, row = fresh("kept"), fresh("digest"), fresh("row")
    kept = assign_groups(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(kept, "exact-kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest), "n")
    alone, repeated = kept.where("n = 1").drop("n"), kept.where("n > 1").drop("n")
    same = F.col(id_col).eqNullSafe(F.col(key)) & (_digest(F.col(text_col)) == F.col(digest))
    out = docs.join(alone, same, "left_semi")
    if not repeated.limit(1).count():
        return out
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = docs.join(repeated, same).groupBy(digest).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return out.unionByName(first.select(f"{row}.*"))
