"""Lifecycle states and their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions import fixed as V


def status_or_active(column: str = "lifecycle_status") -> Column:
    """Rows without a status are active."""
    return F.coalesce(F.col(column), F.lit("active"))


def allowed(old: Column, new: Column) -> Column:
    """Whether the state machine has the transition."""
    test = F.lit(False)
    for state, targets in V.TRANSITIONS.items():
        if targets:
            test = test | ((old == state) & new.isin(*targets))
    return test


def transition(records: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests (uuid, expected, wanted) judged against ``records``: with ``accepted``, and the closed time bounds.

    A request holds only if the record still has the status it expects. A state that ends a
    belief closes both time axes where they are open.
    """
    met = requests.join(records, "uuid")
    old = status_or_active()
    fits = (old == F.col("expected")) & allowed(old, F.col("wanted"))
    ends = fits & F.col("wanted").isin(*V.EXPIRING_STATES)
    return met.select(
        "uuid",
        old.alias("old_status"),
        F.when(fits, F.col("wanted")).otherwise(old).alias("new_status"),
        fits.alias("accepted"),
        F.when(ends, F.coalesce("t_expired", now)).otherwise(F.col("t_expired")).alias("t_expired"),
        F.when(ends, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")).alias("valid_to"),
    )


def stale(records: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Active or confirmed records older than ``days``, with ``age_days``."""
    from stratamem.functions.score import age_days

    old = records.where(status_or_active().isin("active", "confirmed") & (F.col("created_at") < now - F.make_dt_interval(F.lit(days))))
    return old.withColumn("age_days", age_days(F.col("created_at"), now))


#: The state that each wish asks for.
WISHES = {"confirm": "confirmed", "supersede": "superseded", "contradict": "contradicted", "restore": "active", "archive": "archived", "delete": "deleted"}


def wishes(records: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests for ``transition`` from ``asked`` (uuid, wish): each expects the state its record has now."""
    wanted = F.create_map(*(F.lit(x) for pair in WISHES.items() for x in pair))
    now = records.select("uuid", status_or_active().alias("expected"))
    return asked.join(now, "uuid").select("uuid", "expected", F.try_element_at(wanted, F.col("wish")).alias("wanted")).where("wanted is not null")


def archive_stale(records: DataFrame, now: Column, days: int = 30, dry_run: bool = False) -> DataFrame:
    """All ``records`` after the stale ones are archived; with ``dry_run`` the candidates alone, unchanged."""
    candidates = stale(records, now, days)
    if dry_run:
        return candidates
    gone = candidates.select(F.col("uuid").alias("_u"))
    met = records.join(gone, F.col("uuid") == F.col("_u"), "left")
    return met.withColumn("lifecycle_status", F.when(F.col("_u").isNotNull(), F.lit("archived")).otherwise(F.col("lifecycle_status"))).drop("_u")
