"""Registered queries of this subpackage: thin ``opN_<name>`` functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratamem.llm import op_queries, stages
from stratamem.llm.op_sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten operators over their whole tables, and the pipeline."""
    return {**op_queries.QUERIES, "pipeline": stages.run}


def oracles() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return dict(ORACLES)
