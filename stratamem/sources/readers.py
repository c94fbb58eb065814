"""JSON-lines sources with explicit schemas; files are listed and split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamem.functions.text import strip

QUERIES = "query_id string, query string, group_id string, topic_id string"
QRELS = "query_id string, relevant_ids array<string>, relevant array<string>, doc_ids array<string>"
CORPUS = "uuid string, content string, group_id string, episode_type string, importance double, created_at string, topic_id string, topic_index int"
AUDIT = "ts string, job_id string, caller string, mode string, cmd string, argv array<string>, env_keys array<string>, timeout_s double, params_hash string"
_TRANSCRIPT = "role string, type string, content string, message struct<role: string, type: string, content: string>"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON-lines file; a bad line is an error, or (``strict`` false) is left out. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id): relevant ids under any of three keys, the first that isn't empty; the last line of a query wins."""
    rows = json_lines(spark, path, QRELS).where("query_id is not null").withColumn("line", F.monotonically_increasing_id())

    def filled(name: str):
        return F.when(F.size(name) > 0, F.col(name))

    found = rows.select("query_id", "line", F.coalesce(*(filled(c) for c in ("relevant_ids", "relevant", "doc_ids"))).alias("ids"))
    last = found.groupBy("query_id").agg(F.max_by("ids", "line").alias("ids"))
    return last.select("query_id", F.explode("ids").alias("id")).distinct()


def audit(spark: SparkSession, root: str, week: str | None = None) -> DataFrame:
    """Audit lines below ``root``, partitioned by ``week=YYYY-Www``; malformed lines are left out."""
    rows = spark.read.schema(f"{AUDIT}, week string").option("mode", "DROPMALFORMED").json(root)
    return rows if week is None else rows.where(F.col("week") == week)


def transcript(spark: SparkSession, path: str, n: int = 10, longest: int = 250) -> DataFrame:
    """(file, position, text, total): the last ``n`` user messages of each transcript, each on one line and cut, and how many lines the file has.

    A line is a message or holds one under ``message``; ``type`` stands in for a missing role.
    Its content is a text or blocks, whose texts are joined by newlines. Lines that are no
    JSON are counted and left out; blank ones are not counted.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", _TRANSCRIPT).alias("m"))
    nested = F.col("m.message").isNotNull()
    role = F.when(nested, F.coalesce("m.message.role", "m.message.type")).otherwise(F.coalesce("m.role", "m.type"))
    content = F.when(nested, F.col("m.message.content")).otherwise(F.col("m.content"))
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    text = F.when(F.ltrim(content).startswith("[") & blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(content)
    whole = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(whole) > longest, F.concat(F.left(whole, F.lit(longest - 3)), F.lit("..."))).otherwise(whole)
    users = lines.where(role == "user").select("file", "line", short.alias("text")).where("text <> ''")
    back = users.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line")))).where(F.col("_n") <= n)
    totals = lines.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    return back.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("line"))).join(totals, "file").select("file", "position", "text", "total")
