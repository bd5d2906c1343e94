"""Stateful stream processors: idempotent receipts, leases with fencing, worker liveness, retries with a due time and daily quotas.

Each keeps one small state a key in the RocksDB state store (``with_state_store``), expires it by timers or TTL, and gives what its batch counterpart
gives over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .logs import WEEK_MS, in_order

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECEIPTS = "owner string, operation_id string, outcome string"
LEASES = "job string, seq bigint, outcome string, fencing_token bigint"
LIVENESS = "worker string, live boolean, at timestamp"
RETRIES = "job string, outcome string, attempt int, at timestamp"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Receipts(StatefulProcessor):
    """The first request of an operation id is applied, an equal one later replayed, another one a conflict."""

    def __init__(self, keep_ms: int = WEEK_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "operation_id string", "request string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in in_order(rows, ["seq"]).itertuples():
            op = (r.operation_id,)
            known = self.seen.getValue(op)[0] if self.seen.containsKey(op) else None
            if known is None:
                self.seen.updateValue(op, (r.request,))
            out.append((key[0], r.operation_id, "applied" if known is None else "replayed" if known == r.request else "conflict"))
        yield pd.DataFrame(out, columns=["owner", "operation_id", "outcome"])

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Claims give a job a new token until its lease ends by the event's time; a heartbeat or finish under an old token is lost."""

    def __init__(self, lease_seconds: int = 120):
        self.lease_seconds = lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", "fencing_token bigint, until double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in in_order(rows, ["seq"]).itertuples():
            token, until, done = self.lease.get() if self.lease.exists() else (0, 0.0, False)
            now, outcome = r.ts.timestamp(), "lease_lost"
            if r.event == "claim":
                outcome = "finished" if done else "busy" if now < until else "claimed"
                if outcome == "claimed":
                    token, until = token + 1, now + self.lease_seconds
            elif r.token == token and now < until and not done:
                outcome = "finished" if r.event == "finish" else "renewed"
                done, until = r.event == "finish", until if r.event == "finish" else now + self.lease_seconds
            self.lease.update((token, until, done))
            out.append((key[0], r.seq, outcome, token))
        yield pd.DataFrame(out, columns=["job", "seq", "outcome", "fencing_token"])

    def close(self) -> None:
        pass


class Liveness(StatefulProcessor):
    """A worker is live from its first beat; a timer says when it has been silent for ``silent_seconds`` of event time, and one forgets it after ``forget_seconds``."""

    def __init__(self, silent_seconds: int = 90, forget_seconds: int = WEEK_MS // 1000):
        self.silent_ms, self.forget_ms = silent_seconds * 1000, forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows))["ts"]
        newest = int(times.max().timestamp() * 1000)
        held, silent = self.last.get() if self.last.exists() else (None, True)
        if held is None or newest > held:
            self.last.update((newest, False))
            self.handle.registerTimer(newest + self.silent_ms)
            if silent:
                yield pd.DataFrame([(key[0], True, times.min())], columns=["worker", "live", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held, silent = self.last.get() if self.last.exists() else (None, True)
        if held is not None and silent and held + self.forget_ms == due:
            self.last.clear()
        elif held is not None and not silent and held + self.silent_ms == due:
            self.last.update((held, True))
            self.handle.registerTimer(held + self.forget_ms)
            yield pd.DataFrame([(key[0], False, pd.Timestamp(due, unit="ms"))], columns=["worker", "live", "at"])

    def close(self) -> None:
        pass


class Retries(StatefulProcessor):
    """A job waits for its due time and is then let out by a timer; each failure that may be tried again puts it back under a later one, up to ``most_attempts``."""

    def __init__(self, most_attempts: int = 3):
        self.most_attempts = most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "due bigint, attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in in_order(rows, ["seq"]).itertuples():
            due, attempt = self.wait.get() if self.wait.exists() else (0, 0)
            if due:
                self.handle.deleteTimer(due)
            if 0 < due <= r.ts.timestamp() * 1000:  # its timer would have gone off before this event
                attempt += 1
                out.append((key[0], "due", attempt, pd.Timestamp(due, unit="ms")))
            if r.event == "cancel" or attempt >= self.most_attempts:
                self.wait.clear()
                out.append((key[0], "canceled" if r.event == "cancel" else "failed", attempt, r.ts))
            else:
                due = int(r.due.timestamp() * 1000)
                self.handle.registerTimer(due)
                self.wait.update((due, attempt))
        yield pd.DataFrame(out, columns=["job", "outcome", "attempt", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.wait.exists() and self.wait.get()[0] == at:
            attempt = self.wait.get()[1] + 1
            self.wait.update((0, attempt))
            yield pd.DataFrame([(key[0], "due", attempt, pd.Timestamp(at, unit="ms"))], columns=["job", "outcome", "attempt", "at"])

    def close(self) -> None:
        pass


def receipts(operations: DataFrame, *, keep_ms: int = WEEK_MS) -> DataFrame:
    """operations: owner, seq, operation_id, request. Receipts are forgotten ``keep_ms`` after they were written."""
    return operations.groupBy("owner").transformWithStateInPandas(Receipts(keep_ms), RECEIPTS, "append", "processingTime")


def leases(events: DataFrame, *, lease_seconds: int = 120) -> DataFrame:
    """events: job, seq, event (claim, heartbeat, finish), token, ts."""
    return events.groupBy("job").transformWithStateInPandas(Leases(lease_seconds), LEASES, "append", "none")


def liveness(beats: DataFrame, *, silent_seconds: int = 90) -> DataFrame:
    """beats: worker, ts with a watermark on ts."""
    return beats.groupBy("worker").transformWithStateInPandas(Liveness(silent_seconds), LIVENESS, "append", "eventTime")


def retries(events: DataFrame, *, most_attempts: int = 3) -> DataFrame:
    """events: job, seq, event (queue, retry, cancel), due timestamp, ts with a watermark."""
    return events.groupBy("job").transformWithStateInPandas(Retries(most_attempts), RETRIES, "append", "eventTime")


def daily_counts(jobs: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Jobs of each owner by UTC day, final once the watermark has passed the day."""
    return jobs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("day"), "owner").agg(F.count("*").alias("jobs")).select("owner", F.col("day.start").alias("day"), "jobs")


def recent_failures(jobs: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Failures of the last hour, every ten minutes."""
    w = F.window("created_at", "1 hour", "10 minutes").alias("w")
    return jobs.withWatermark("created_at", late).where("status = 'failed'").groupBy(w).agg(F.count("*").alias("failed")).select(F.col("w.end").alias("at"), "failed")
