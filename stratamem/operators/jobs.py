"""Job queue as batch state transitions: each operator answers for all requests of a batch at once.

Jobs have job_id, name, queue, status, attempts, max_attempts, priority, created_at,
scheduled_at, claimed_at, worker_id, parent_id, depth, idempotency_key, timeout_seconds,
failed_at, completed_at, failure_reason, result; an operator reads the columns it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions import fixed as V
from stratamem.functions.guard import retry_wait
from stratamem.operators.rank import top_k
from stratamem.operators.trees import descendants
from stratamem.sources.scratch import written


def _met(rows: DataFrame, keys: list[str], *others: tuple[DataFrame, Column]) -> DataFrame:
    """``rows`` with what they meet in ``others`` (table, test) by ``keys``, or nulls. Rows without a key
    meet nothing and are left where they are: in a join by key they would all go to one task."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    met = rows.where(keyed)
    for other, test in others:
        met = met.join(other, test, "left")
    return met.unionByName(rows.where(~keyed), allowMissingColumns=True)


def submit(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """What becomes of ``requests`` (job_id, name, idempotency_key, parent_id, priority, timeout_seconds, max_attempts, scheduled_at).

    Per request ``job_id`` (an existing job's where name and key were known, the first
    request's of a batch), ``reason`` (null if in order), ``created``, ``depth`` and
    ``scheduled_at``. The first of these reasons is given: ``name``, ``timeout_seconds``,
    ``max_attempts``, ``parent_id`` (unknown), ``depth`` (over ``MAX_DEPTH``), ``children``
    (the parent has ``MAX_CHILDREN``, those before in the batch by job_id included).
    Requests whose parent comes in the same batch belong in the next one.

    A batch is as if its requests came one by one, in the order of job_id. Once a parent is
    full all later requests under it are refused, so a key may pass on to a later request,
    which may fill another parent: rounds go on until no parent is full earlier than before.
    Only a parent's first ``MAX_CHILDREN`` new jobs are ranked, and keys are met by their
    least request, so neither many children nor many requests without a key meet in one task.
    """
    counts = jobs.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("_children"))
    parents = jobs.select(F.col("job_id").alias("_p"), F.col("depth").alias("_depth"))
    known = jobs.where("idempotency_key is not null").groupBy(F.col("name").alias("_name"), F.col("idempotency_key").alias("_key")).agg(F.min("job_id").alias("_existing"))
    met = _met(requests, ["parent_id"], (parents, F.col("parent_id") == F.col("_p")), (counts.withColumnRenamed("parent_id", "_q"), F.col("parent_id") == F.col("_q")))
    met = _met(met, ["name", "idempotency_key"], (known, (F.col("name") == F.col("_name")) & (F.col("idempotency_key") == F.col("_key"))))
    depth = F.when(F.col("parent_id").isNull(), 0).otherwise(F.col("_depth") + 1)
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", F.lit("name"))
        .when(F.col("timeout_seconds") <= 0, F.lit("timeout_seconds"))
        .when(F.col("max_attempts") < 1, F.lit("max_attempts"))
        .when(F.col("parent_id").isNotNull() & F.col("_p").isNull(), F.lit("parent_id"))
        .when(depth > V.MAX_DEPTH, F.lit("depth"))
        .when(F.coalesce("_children", F.lit(0)) >= V.MAX_CHILDREN, F.lit("children"))
    )
    judged = written(met.withColumns({"depth": depth, "reason": reason}), "requests")
    full, state = None, None
    while True:
        left = judged.where("reason is null")
        if full is not None:
            left = _met(left, ["parent_id"], (full, F.col("parent_id") == F.col("_parent"))).where(F.col("_full_at").isNull() | (F.col("job_id") <= F.col("_full_at")))
        firsts = left.where("idempotency_key is not null and _existing is null").groupBy(F.col("name").alias("_n"), F.col("idempotency_key").alias("_k")).agg(F.min("job_id").alias("_first"))
        made = left.where("idempotency_key is null").select("job_id", "parent_id", "_children").unionByName(
            left.join(firsts, F.col("job_id") == F.col("_first"), "left_semi").select("job_id", "parent_id", "_children")
        )
        last = top_k(made.where("parent_id is not null"), ["parent_id"], V.MAX_CHILDREN, F.asc("job_id"))
        found = last.where(F.col("rank") + F.coalesce("_children", F.lit(0)) == V.MAX_CHILDREN)
        found = written(found.select(F.col("parent_id").alias("_parent"), F.col("job_id").alias("_full_at")), "full-parents")
        before, state = state, found.agg(F.count(F.lit(1)), F.sum("_full_at")).first()
        full = found
        if state == before or not state[0]:
            break
    met = _met(judged, ["parent_id"], (full, F.col("parent_id") == F.col("_parent")))
    met = _met(met, ["name", "idempotency_key"], (firsts, (F.col("name") == F.col("_n")) & (F.col("idempotency_key") == F.col("_k"))))
    refused = F.coalesce("reason", F.when(F.col("job_id") > F.col("_full_at"), F.lit("children")))
    first = F.coalesce("_existing", "_first", "job_id")
    return met.withColumn("_reason", refused).select(
        F.col("job_id").alias("request_id"),
        F.when(F.col("_reason").isNull(), first).alias("job_id"),
        F.col("_reason").alias("reason"),
        (F.col("_reason").isNull() & F.col("_existing").isNull() & (first == F.col("job_id"))).alias("created"),
        F.when(F.col("_reason").isNull(), F.col("depth")).alias("depth"),
        F.coalesce("scheduled_at", now).alias("scheduled_at"),
    )


def claim(jobs: DataFrame, now: Column, n: int, keys: list[str]) -> DataFrame:
    """The next ``n`` pending jobs of each queue: highest priority, then the longest due."""
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") <= now))
    return top_k(due, keys, n, F.desc("priority"), F.asc("scheduled_at"), F.asc("job_id"))


def claimed(jobs: DataFrame, now: Column, n: int, keys: list[str], worker_id: Column) -> DataFrame:
    """All ``jobs`` after the claim: those claimed belong to the worker, with one more attempt."""
    taken = claim(jobs, now, n, keys).select(F.col("job_id").alias("_taken"))
    met, mine = jobs.join(taken, F.col("job_id") == F.col("_taken"), "left"), F.col("_taken").isNotNull()
    changes = {"status": F.lit("claimed"), "claimed_at": now, "worker_id": worker_id, "attempts": F.col("attempts") + 1}
    return met.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_taken")


def complete(jobs: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, inbox) after ``results`` (job_id, result): claimed jobs are complete, and their parents' inbox
    (parent_id, child_id, result, completed_at) has a row for each. Other jobs stay as they are."""
    asked = results.select(F.col("job_id").alias("_id"), F.col("result").alias("_result"))
    met = jobs.join(asked, F.col("job_id") == F.col("_id"), "left").withColumn("_done", F.col("_id").isNotNull() & (F.col("status") == "claimed"))
    changes = {"status": F.lit("complete"), "completed_at": now, "result": F.col("_result")}
    out = met.withColumns({c: F.when(F.col("_done"), v).otherwise(F.col(c)) for c, v in changes.items()})
    inbox = out.where("_done and parent_id is not null").select("parent_id", F.col("job_id").alias("child_id"), "result", "completed_at")
    return out.drop("_id", "_result", "_done"), inbox


def collected(inbox: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the inbox rows of ``parents`` (parent_id), and the inbox without them."""
    return inbox.join(parents, "parent_id", "left_semi"), inbox.join(parents, "parent_id", "left_anti")


def fail(jobs: DataFrame, failures: DataFrame, now: Column, longest: int = 500) -> DataFrame:
    """All ``jobs`` after ``failures`` (job_id, reason, retriable) of claimed ones.

    A retriable job with attempts left is pending again after a growing pause; without, it
    is ``dead``; one that is not retriable is ``failed``.
    """
    asked = failures.select(F.col("job_id").alias("_id"), F.left("reason", F.lit(longest)).alias("_reason"), F.col("retriable").alias("_again"))
    met = jobs.join(asked, F.col("job_id") == F.col("_id"), "left").withColumn("_mine", F.col("_id").isNotNull() & (F.col("status") == "claimed"))
    again = F.col("_mine") & F.col("_again") & (F.col("attempts") < F.col("max_attempts"))
    ended = F.col("_mine") & ~again
    wait = F.make_dt_interval(secs=retry_wait(F.greatest("attempts", F.lit(1))).cast("decimal(18,6)"))
    met = met.withColumns({"_retry": again, "_ended": ended})
    return met.withColumns(
        {
            "status": F.when(F.col("_retry"), "pending").when(F.col("_ended"), F.when(F.col("_again"), "dead").otherwise("failed")).otherwise(F.col("status")),
            "scheduled_at": F.when(F.col("_retry"), now + wait).otherwise(F.col("scheduled_at")),
            "claimed_at": F.when(~F.col("_retry"), F.col("claimed_at")),
            "worker_id": F.when(~F.col("_retry"), F.col("worker_id")),
            "failed_at": F.when(F.col("_ended"), now).otherwise(F.col("failed_at")),
            "failure_reason": F.when(F.col("_mine"), F.col("_reason")).otherwise(F.col("failure_reason")),
        }
    ).drop("_id", "_reason", "_again", "_mine", "_retry", "_ended")


def cancel(jobs: DataFrame, asked: DataFrame, now: Column, cascade: bool = True) -> DataFrame:
    """All ``jobs`` after the cancelling of ``asked`` (job_id) and, with ``cascade``, of all below them; ended ones stay."""
    tops = asked.select(F.col("job_id").alias("id"))
    gone = descendants(jobs.select(F.col("job_id").alias("id"), F.col("parent_id").alias("parent")), tops) if cascade else tops.distinct()
    met = jobs.join(gone.select(F.col("id").alias("_id")), F.col("job_id") == F.col("_id"), "left")
    met = met.withColumn("_gone", F.col("_id").isNotNull() & ~F.col("status").isin(*V.TERMINAL_STATES))
    changes = {"status": F.lit("cancelled"), "failed_at": now, "failure_reason": F.lit("cancelled")}
    return met.withColumns({c: F.when(F.col("_gone"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_id", "_gone")


def renew(jobs: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """All ``jobs`` after the renewal of ``leases`` (job_id, worker_id) by the workers that still hold them."""
    asked = leases.select(F.col("job_id").alias("_id"), F.col("worker_id").alias("_worker")).distinct()
    met = jobs.join(asked, (F.col("job_id") == F.col("_id")) & (F.col("worker_id") == F.col("_worker")), "left")
    held = F.col("_id").isNotNull() & (F.col("status") == "claimed")
    return met.withColumn("claimed_at", F.when(held, now).otherwise(F.col("claimed_at"))).drop("_id", "_worker")


def log_lines(lines: DataFrame, now: Column, longest: int = 2000) -> DataFrame:
    """(job_id, ts, level, message) to append to the log, of (job_id, level, message)."""
    return lines.select("job_id", now.alias("ts"), F.upper("level").alias("level"), F.left("message", F.lit(longest)).alias("message"))


def stalled(jobs: DataFrame, now: Column, status: str = "running") -> DataFrame:
    """Jobs at work that were claimed more than twice their timeout ago."""
    limit = F.col("claimed_at") + F.make_dt_interval(secs=(2 * F.col("timeout_seconds")).cast("decimal(18,6)"))
    return jobs.where((F.col("status") == status) & (limit < now))


def retry(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed jobs with their next state: pending again after a growing pause, or dead."""
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumns(
        {
            "next_status": F.when(again, F.lit("pending")).otherwise(F.lit("dead")),
            "wait_seconds": F.when(again, retry_wait(F.col("attempts"))),
        }
    )
