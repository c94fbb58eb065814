"""What several operators of this subpackage need: shared scratch space and column hygiene."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Unset, a local session gets a temporary folder; a cluster session is refused, since
    a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratamem-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a reread, not a recomputation, and lets
    several consumers read only the columns they need.
    """
    path = f"{scratch_root(df.sparkSession)}/stratamem/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that reads them has been written itself."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the written tables of all operators, once no result that reads them is needed."""
    _delete(spark, f"{scratch_root(spark)}/stratamem")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Hold Arrow batches to ``rows`` rows while an eager action runs, so long texts stay within memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of an Arrow batch; texts may be long.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows, for results that are computed later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def lean(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run`` over batches, after which the worker, which lives on, hands free memory back to the system."""

    def held(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not on every C library
                ctypes.CDLL(None).malloc_trim(0)

    return held


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values of ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


#: Rows of a range of ``with_before``, about.
RANGE_ROWS = 1 << 16


def with_before(df: DataFrame, order: list[str], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with, as each key of ``sums``, the sum of that column over all rows before a row in ``order`` (0 for the first).

    Rows go to ranges of about ``RANGE_ROWS``, each summed by itself; only one row for each
    range meets in one place. ``order`` names columns that are distinct together and not null.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    dealt = materialise(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    offsets = totals.select(F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).join(offsets, F.col("_range") == F.col("_r"))
    return found.select(*df.columns, *((F.col(name) + F.col(f"_o_{name}")).alias(name) for name in sums))
