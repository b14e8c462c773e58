"""The keyed job state machine: a batch plan over an event log, and a stream with timers.

Events are enqueue, claim, heartbeat, succeed, fail and cancel. A job that fails is queued again until its attempts are used up; a running job
without a heartbeat for ``STALLED`` counts as a failed attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.functions.text import joined_key

STALLED_MINUTES, MAX_ATTEMPTS = 15, 3
STAGES = ("quality", "handwriting", "diagnosis")


def idempotency_key(kind: Column, page: Column, document: Column, salt: Column | None = None) -> Column:
    return joined_key(kind, page, document, salt if salt is not None else F.lit(""))


def fan_out(pages: DataFrame, stages: tuple[str, ...] | None = None) -> DataFrame:
    """A job for each page and stage. None means all stages, an empty tuple none."""
    wanted = STAGES if stages is None else stages
    rows = pages.withColumn("kind", F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")))
    return rows.withColumn("job_key", idempotency_key(F.col("kind"), F.col("page_id"), F.lit(None)))


def enqueued(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """The job table after requests for work, each key once: a job that failed or was cancelled starts anew, any other stays as it is.

    ``requests``: kind, page_id, document_id and salt, all may be null but kind. ``jobs``: job_key, kind, page_id, document_id, state, attempt, error, queued_at.
    One outer join by key; repeated requests are one, since equal keys have equal parts.
    """
    keyed = requests.withColumn("job_key", idempotency_key(F.col("kind"), F.col("page_id"), F.col("document_id"), F.col("salt")))
    asked = keyed.groupBy("job_key").agg(*[F.min(c).alias(f"_{c}") for c in ("kind", "page_id", "document_id")], F.lit(True).alias("_asked"))
    new, again = F.col("state").isNull(), F.col("_asked").isNotNull() & F.col("state").isin("failed", "cancelled")
    start = F.coalesce(new | again, F.lit(False))
    return jobs.join(asked, "job_key", "full").select(
        "job_key", *[F.coalesce(c, f"_{c}").alias(c) for c in ("kind", "page_id", "document_id")], F.when(start, "queued").otherwise(F.col("state")).alias("state"),
        F.when(start, 0).otherwise(F.col("attempt")).alias("attempt"), F.when(~start, F.col("error")).alias("error"), F.when(start, now).otherwise(F.col("queued_at")).alias("queued_at"))


def stalled_sweep(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs without a recent heartbeat go back to the queue, or fail when their attempts are used up; others stay."""
    late = (F.col("state") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {STALLED_MINUTES} MINUTES")))
    late = F.coalesce(late, F.lit(False))
    return jobs.withColumns({"attempt": F.when(late, F.col("attempt") + 1).otherwise(F.col("attempt")),
                             "state": F.when(late, F.when(F.col("attempt") + 1 < most, "queued").otherwise("failed")).otherwise(F.col("state"))})


def dispatch(jobs: DataFrame, n: int) -> DataFrame:
    """The next ``n`` queued jobs, first come first served."""
    return jobs.filter("state = 'queued'").orderBy(F.asc_nulls_last("queued_at"), "job_id").limit(n)


def step(state: str | None, attempt: int, event: str, most: int = MAX_ATTEMPTS) -> tuple[str | None, int]:
    """The state after an event. Events that a state doesn't know leave it as it is."""
    if event == "enqueue":
        return ("queued", 0) if state in (None, "failed", "cancelled") else (state, attempt)
    if event == "claim" and state == "queued":
        return "running", attempt
    if event == "succeed" and state == "running":
        return "succeeded", attempt
    if event in ("fail", "stalled") and state == "running":
        return ("queued" if attempt + 1 < most else "failed"), attempt + 1
    if event == "cancel" and state not in (None, "succeeded", "cancelled"):
        return "cancelled", attempt
    return state, attempt


def replayed(events: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each job after its whole log: job_key, state, attempt, transitions.

    A job's log is folded in time order inside an aggregate; ``events`` has job_key, event, at and event_id. A job has few events: its
    attempts are limited.
    """
    log = F.array_sort(F.collect_list(F.struct("at", "event_id", "event")))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("attempt"), F.lit(0).alias("n"))

    def fold(a: Column, e: Column) -> Column:
        s, k, n, name = a["state"], a["attempt"], a["n"], e["event"]
        ended = name.isin("fail", "stalled") & (s == "running")
        to = (F.when((name == "enqueue") & (s.isNull() | s.isin("failed", "cancelled")), "queued").when((name == "claim") & (s == "queued"), "running")
              .when((name == "succeed") & (s == "running"), "succeeded").when(ended, F.when(k + 1 < most, "queued").otherwise("failed"))
              .when((name == "cancel") & s.isNotNull() & ~s.isin("succeeded", "cancelled"), "cancelled"))
        attempt = F.when(to.isNull(), k).when(name == "enqueue", 0).when(ended, k + 1).otherwise(k)
        return F.struct(F.coalesce(to, s).alias("state"), attempt.alias("attempt"), (n + F.when(to.isNotNull(), 1).otherwise(0)).alias("n"))

    return (events.groupBy("job_key").agg(log.alias("log")).withColumn("end", F.aggregate("log", start, fold))
            .select("job_key", F.col("end.state").alias("state"), F.col("end.attempt").alias("attempt"), F.col("end.n").alias("transitions")))


class JobProcessor(StatefulProcessor):
    """``transformWithStateInPandas`` form of ``step``: emits each job's state after every change; a timer ends attempts that went silent."""

    def __init__(self, most: int = MAX_ATTEMPTS, stalled_ms: int = STALLED_MINUTES * 60_000):
        self.most, self.stalled_ms = most, stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempt int")

    def _set(self, key: tuple, state: str | None, attempt: int, now: int) -> pd.DataFrame:
        self.job.update((state, attempt))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if state == "running":
            self.handle.registerTimer(now + self.stalled_ms)
        return pd.DataFrame({"job_key": [key[0]], "state": [state], "attempt": [attempt]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, attempt = self.job.get() if self.job.exists() else (None, 0)
        log = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for event in log["event"]:
            state, attempt = step(state, attempt, event, self.most)
        yield self._set(key, state, attempt, timer_values.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, attempt = self.job.get() if self.job.exists() else (None, 0)
        state, attempt = step(state, attempt, "stalled", self.most)
        yield self._set(key, state, attempt, timer_values.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The state machine on a stream of events; needs the RocksDB state store."""
    return events.groupBy("job_key").transformWithStateInPandas(JobProcessor(most), "job_key string, state string, attempt int", "Update", "ProcessingTime")
