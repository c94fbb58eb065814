"""The ``opN_<name>`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import cross_align, exact_dedup, jaccard_join, language_id, mixing, multi_index, packing, secret_scan, suffix_dedup, token_count, toxicity, turn_repair, winnowing
from stratamem.sources.tables import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words taken of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _fold(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside fold 1 of 3."""
    found = language_id.identify(table(spark, sf_dir, "documents"), _fold(3) != 1)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and its number of links."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy group of every document, and which row of it stays."""
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside fold 0 of 5."""
    _, scored = toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(5) != 0)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = winnowing.compare_with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        winnowing.as_string(F.col("prints")).alias("fingerprint"),
        winnowing.as_string(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed 512."""
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def packed_digests(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with a digest of its ids and its place."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = cut.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digests, packing.place(cut)).drop("row")


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of 4096 tokens."""
    return packed_digests(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of two tokenizers over every document."""
    found = cross_align.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("groups_sha256", cross_align.digest(F.col("groups"))).drop("groups")


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    found = multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation after damage."""
    return turn_repair.damaged_digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_language_id,
        op3_jaccard_join,
        op4_exact_dedup,
        op5_toxicity,
        op6_winnowing,
        op7_token_counts,
        op8_best_two_fit,
        op9_secret_scan,
        op10_suffix_dedup,
        op11_cross_align,
        op12_multi_index,
        op13_turn_repair,
    )
}
