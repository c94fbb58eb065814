"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

import stratamem


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from wherever the driver did.

    On a cluster the package is deployed with ``--py-files`` or is installed on the executors.
    """
    root = str(Path(stratamem.__file__).resolve().parent.parent)
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local") and root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
