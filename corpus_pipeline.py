"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, best-fit packing."""

from stratamem.llm.stages import STAGES, run

#: Learned scores, near copies, rounding and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
