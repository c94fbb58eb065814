"""Mutations of immutable tables: appends, rewrites by key, upserts, inserts of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rewrite_by_key(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows whose key ``delta`` has replaced by it, and the new ones added."""
    return old.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def current(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key of an append-only table."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return versions.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def update(rows: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``delta`` where it has the key and they aren't null."""
    changed = [c for c in delta.columns if c not in keys]
    met = rows.join(delta.withColumnsRenamed({c: f"_new_{c}" for c in changed}), keys, "left")
    return met.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in rows.columns))


def upsert_pages(pages: DataFrame, requests: DataFrame, now: Column, longest: int = 2000) -> DataFrame:
    """Pages (slug, domain, compiled_truth, created_at, updated_at) after requests (slug, domain, compiled_truth).

    A request with a truth replaces it and the domain; one without keeps the truth, and the
    domain where there is one. Both touch ``updated_at``. Slugs that aren't valid are left out.
    """
    from stratamem.functions.text import is_slug

    asked = requests.where(is_slug(F.col("slug"))).select("slug", F.col("domain").alias("_d"), F.left("compiled_truth", F.lit(longest)).alias("_t"), F.lit(True).alias("_asked"))
    met = pages.join(asked, "slug", "full")
    given = F.col("_t").isNotNull()
    return met.select(
        "slug",
        F.when(given, F.col("_d")).otherwise(F.coalesce("domain", "_d")).alias("domain"),
        F.when(given, F.col("_t")).otherwise(F.coalesce("compiled_truth", F.lit(""))).alias("compiled_truth"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_asked"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def insert_new(rows: DataFrame, arriving: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The arriving rows that are new: the first of each key that ``rows`` has not. Rows with a null key are always new."""
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    first = arriving.where(~keyless).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(rows.select(*keys), keys, "left_anti").unionByName(arriving.where(keyless))


def backfill(rows: DataFrame, column: str, *sources: Column) -> DataFrame:
    """``rows`` with the column filled from the first source that has a value, where it is null."""
    return rows.withColumn(column, F.coalesce(F.col(column), *sources))


def pending(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, pending): how many rows a backfill of each column would fill."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("pending")) for c in columns))))


def undo_backfill(rows: DataFrame, column: str, filled: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the column null again for the keys of ``filled``."""
    marks = filled.select(*keys).distinct().withColumn("_filled", F.lit(True))
    met = rows.join(marks, keys, "left")
    return met.withColumn(column, F.when(F.col("_filled").isNull(), F.col(column))).drop("_filled")


def split_valid(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose required keys are all there and not blank, and the others with ``missing``."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required)))
    judged = rows.withColumn("missing", missing)
    return judged.where(F.size("missing") == 0).drop("missing"), judged.where(F.size("missing") > 0)


def commit_batch(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """Several tables written as one: a batch counts once its marker is there, which is written last."""
    for name, rows in tables.items():
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(batch_id).alias("committed")).write.mode("overwrite").parquet(f"{root}/_committed/batch={batch_id}")


def committed(spark, root: str, name: str) -> DataFrame:
    """The rows of a table whose batch was committed."""
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/*")
    marks = spark.read.parquet(f"{root}/_committed/*").select(F.col("committed").alias("batch_id"))
    return rows.join(marks, "batch_id", "left_semi").drop("batch")


def append_json(rows: DataFrame, path: str, *partitions: str) -> None:
    """JSON lines, partitioned."""
    rows.write.mode("append").partitionBy(*partitions).json(path)


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose key ``gone`` has."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def delete_namespace(tables: dict[str, DataFrame], group_id: str, column: str = "group_id") -> dict[str, DataFrame]:
    """All tables without the rows of a group; edges (from_id, to_id) that lose an end go too, if a table ``nodes`` (id) is among them."""
    left = {name: rows.where(~F.col(column).eqNullSafe(F.lit(group_id))) if column in rows.columns else rows for name, rows in tables.items()}
    if "nodes" in left and "edges" in left:
        known = left["nodes"].select("id")
        left["edges"] = left["edges"].join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return left


def plan_schema(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """What is to be made: the ``wanted`` constraints and indexes that aren't ``there``. Applied twice it plans nothing."""
    return wanted.join(there.select(*keys), keys, "left_anti").distinct()


def apply_schema(there: DataFrame, planned: DataFrame, undo: bool = False) -> DataFrame:
    """The catalogue after the plan, or after it is rolled back."""
    return there.join(planned, planned.columns, "left_anti") if undo else there.unionByName(planned, allowMissingColumns=True).distinct()
