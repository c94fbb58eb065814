"""Timers of the job queue: leases that run out and retries that come due, as keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A lease lasts so many times its timeout.
LEASE = 2
#: Seconds of the first pause before a retry, which doubles, and of the longest.
FIRST_PAUSE, LONGEST_PAUSE = 5, 3600
#: What a job's state is: who holds it or that it waits, when that ends (ms), and its attempts.
STATE = "job_id long, phase string, worker_id string, ends long, lasts long, attempts int"
EVENTS = "job_id long, event string, at timestamp, worker_id string, attempts int"
#: State stores with timers need this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of jobs that share state and a timer.
BUCKETS = 1024


def pause_ms(attempts: int) -> int:
    return 1000 * min(LONGEST_PAUSE, FIRST_PAUSE * 2 ** min(max(0, attempts - 1), 20))


class Timers(StatefulProcessor):
    """The jobs of one bucket: a timer stands at the earliest end of a lease or pause among them.

    Events of a micro-batch come in the order of their time. A timer whose time lies before
    the next event has fired by then, even if the watermark comes to it only later, so how
    the stream is cut into batches makes no difference.

    A bucket's state is read and written as a whole, as each call to the state store takes
    longer than many events do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", STATE)

    def _known(self) -> dict:
        return {job: state for job, *state in self.jobs.get()} if self.jobs.exists() else {}

    def _keep(self, known: dict) -> None:
        # how often a job was tried is kept for as long as the job is known
        self.jobs.put([(job, *state) for job, state in known.items()])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, fired = self._known(), []
        timer = _earliest(known)
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        times = (batch["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        jobs = batch["job_id"].tolist() if key[0] >= 0 else [None] * len(batch)
        for job, kind, at, who, timeout, most in zip(jobs, batch["kind"], times, batch["worker_id"], batch["timeout_seconds"], batch["max_attempts"], strict=True):
            phase, worker, ends, lasts, attempts = known.get(job) or (None, None, None, None, 0)
            if phase and at > ends:
                fired.append((job, "expired" if phase == "held" else "due", ends, worker if phase == "held" else None, attempts))
                phase = None
            if kind == "claim":
                phase, worker, lasts, attempts = "held", who, 1000 * LEASE * int(timeout), attempts + 1
                ends = at + lasts
            elif phase == "held" and who == worker:
                if kind == "renew":
                    ends = at + lasts
                elif kind == "fail" and attempts < most:
                    phase, ends = "waiting", at + pause_ms(attempts)
                else:
                    phase = None
            known[job] = (phase, worker, ends, lasts, attempts)
        self._keep(known)
        if (now := _earliest(known)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now)
        if fired:
            yield _fired(fired)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, fired = self._known(), []
        # all that the watermark has passed, as Spark has it for timers
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for job, (phase, worker, ends, lasts, attempts) in known.items():
            if phase and ends <= until:
                known[job] = (None, None, None, lasts, attempts)
                fired.append((job, "expired" if phase == "held" else "due", ends, worker if phase == "held" else None, attempts))
        if fired:
            self._keep(known)
            if (now := _earliest(known)) is not None:
                self.handle.registerTimer(now)
            yield _fired(fired)

    def close(self) -> None:
        pass


def _earliest(known: dict) -> int | None:
    return min((ends for phase, _, ends, _, _ in known.values() if phase), default=None)


def _fired(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=["job_id", "event", "at", "worker_id", "attempts"])
    return found.assign(at=pd.to_datetime(found["at"], unit="ms"), attempts=found["attempts"].astype("int32"))


def queue_timers(stream: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(job_id, event, at, worker_id, attempts): what the timers of ``stream`` fire, each once.

    ``stream`` has event_id, job_id, kind, at, worker_id, timeout_seconds, max_attempts. A
    ``claim`` gives its worker a lease of twice the timeout and counts as an attempt, and ends
    what was before; ``renew`` by that worker starts the lease anew; ``complete`` ends it;
    ``fail`` ends it and, with attempts left, starts a pause. ``expired`` fires at the end of a
    lease that was neither renewed nor ended by then, ``due`` at the end of a pause after which
    the job can be tried again. Once a lease has run out its worker has no say any more.
    Events may be late by ``delay``; timers fire once the watermark has passed them.

    Jobs share ``buckets`` states, so that calls to the state store don't grow with the jobs;
    a task holds one bucket's jobs and events of a micro-batch at a time. A stream keeps its number.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    # a missing job has a bucket of its own, as pandas would take the ids beside it for floats
    bucket = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(buckets))).cast("int")
    return stream.withWatermark("at", delay).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Timers(), outputStructType=EVENTS, outputMode="append", timeMode="EventTime")
