"""Tables that grow by versions of deltas, merged by key when read and compacted now and then."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folds rows of one key; folding folded rows again must give the same.
Merge = Callable[[DataFrame], DataFrame]


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names below a folder of any file system that Spark reads; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file; False if it is there already and is not to be replaced, which the file system decides."""
    from py4j.protocol import Py4JJavaError

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, replace)
    except Py4JJavaError as error:
        if not replace and "exist" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def got(spark: SparkSession, path: str) -> str:
    """The first line of a small file; empty if its writer did not end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark._jvm.java.io.InputStreamReader(place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place))
    reader = spark._jvm.java.io.BufferedReader(stream)
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def kept_first(keys: list[str]) -> Merge:
    """The first version's row of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        top = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "version").alias("_row"), F.min("version").alias("_version"))
        return top.select(*keys, *(F.col("_version").alias(c) if c == "version" else F.col(f"_row.{c}").alias(c) for c in rest))

    return merge


def kept_last(keys: list[str]) -> Merge:
    """The last version's row of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
        return top.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))

    return merge


class DeltaTables:
    """Several tables below ``root`` whose deltas are committed together.

    A version is one delta of each table, and counts once its marker is there, which is
    written last: readers see all tables of a version or none. A version written again
    replaces itself. ``merges`` folds the deltas of a table by key; all rows have ``version``.
    Tables without a merge are appended to.

    The versions since the last base are listed by the driver; ``compact`` folds them into a base.
    """

    def __init__(self, spark: SparkSession, root: str, merges: dict[str, Merge | None]):
        self.spark, self.root, self.merges = spark, root.rstrip("/"), merges

    def versions(self, before: int | None = None) -> tuple[str | None, list[str]]:
        """The folder of the latest base, and of the versions committed after it, all under ``before``, in order."""
        base, deltas = self._found(before)
        return (None if base is None else f"base-{base}"), [f"delta-{v}{n}" for v, n in deltas]

    def _found(self, before: int | None) -> tuple[int | None, list[tuple[int, str]]]:
        found: dict[str, list[int]] = {"base": [], "delta": []}
        for name in listed(self.spark, f"{self.root}/_log"):
            if (m := re.fullmatch(r"(base|delta)-(\d+)", name)) and (before is None or int(m[2]) < before):
                found[m[1]].append(int(m[2]))
        base = max(found["base"], default=None)
        names = [(v, got(self.spark, f"{self.root}/_log/delta-{v}")) for v in sorted(found["delta"]) if base is None or v > base]
        return base, [(v, "" if n == "-" else f"-{n}") for v, n in names if n]

    def next_version(self) -> int:
        """The first version that no writer has begun to commit."""
        taken = [int(m[1]) for name in listed(self.spark, f"{self.root}/_log") if (m := re.fullmatch(r"(?:base|delta)-(\d+)", name))]
        return max(taken, default=-1) + 1

    def _write(self, folder: str, deltas: dict[str, DataFrame], version: int) -> None:
        for name, rows in deltas.items():
            rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.root}/{name}/{folder}")

    def commit(self, version: int, deltas: dict[str, DataFrame]) -> None:
        """Write the version, over itself if it is there; until its marker is there nothing of it is read."""
        self._write(f"delta-{version}", deltas, version)
        put(self.spark, f"{self.root}/_log/delta-{version}", "-", replace=True)

    def commit_if_absent(self, version: int, deltas: dict[str, DataFrame]) -> bool:
        """Write the version unless another writer has taken it, which leaves no trace that is read."""
        own = uuid.uuid4().hex
        self._write(f"delta-{version}-{own}", deltas, version)
        return put(self.spark, f"{self.root}/_log/delta-{version}", own)

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The table as of all versions under ``before``; None if there is none."""
        base, deltas = self.versions(before)
        paths = [f"{self.root}/{name}/{folder}" for folder in ([base] if base else []) + deltas]
        if not paths:
            return None
        schema = self.spark.read.parquet(paths[-1]).schema
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows if self.merges[name] is None else self.merges[name](rows)

    def compact(self, before: int) -> None:
        """Fold the versions under ``before`` into a base; leave out the last ones that may still be written again."""
        _, deltas = self._found(before)
        if deltas:
            last = deltas[-1][0]
            for name in self.merges:
                self.read(name, before).write.mode("overwrite").parquet(f"{self.root}/{name}/base-{last}")
            put(self.spark, f"{self.root}/_log/base-{last}", "-", replace=True)
