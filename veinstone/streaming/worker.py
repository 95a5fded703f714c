"""The worker loop as a stateful stream: leases and retries are timers, finished jobs leave no state.

The stream reads what happened to jobs (submitted, claimed, succeeded, failed) and tells what the loop has
to do next: a job is ready again when its lease runs out or its delay is over, and over when it has
succeeded or failed for the last time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veinstone.operators.queue import MAX_ATTEMPTS, MAX_DELAY

LEASE_SECONDS = 300
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "status string, attempts int, deadline long"
OUTPUT = "job_id long, action string, attempts int, at_us long"


def apply_event(state: tuple | None, kind: str, at: int) -> tuple[tuple | None, str | None]:
    """(state, action) after an event at a microsecond; a state is (status, attempts, deadline or None)."""
    status, attempts, _ = state or ("pending", 0, None)
    if kind == "claimed":
        return ("processing", attempts + 1, at + LEASE_SECONDS * 1_000_000), None
    if kind == "failed":
        if attempts >= MAX_ATTEMPTS:
            return None, "dead"
        return ("pending", attempts, at + min(MAX_DELAY, 2 ** min(attempts, 8)) * 1_000_000), None
    if kind == "succeeded":
        return None, "done"
    return (status, attempts, state[2] if state else None), None if state else "ready"


def overdue(state: tuple | None, at: int) -> tuple[tuple | None, tuple | None]:
    """(state, (action, attempts, when)) once ``at`` is reached: a lease or a delay may have run out."""
    if state is None or state[2] is None or state[2] > at:
        return state, None
    status, attempts, deadline = state
    return ("pending", attempts, None), ("lease_expired" if status == "processing" else "ready", attempts, deadline)


class WorkerLoop(StatefulProcessor):
    """State per job: status, attempts and the one deadline that counts, with a timer on it.

    A deadline that an event of the same batch has passed is settled before the event, so the actions do
    not depend on how events fall into batches; the timer is for jobs that fall silent.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.job.get()) if self.job.exists() else None
        before = state
        for row in sorted(rows, key=lambda r: (r.at_us, r.event_id)):
            state, action = overdue(state, row.at_us)
            if action:
                yield self._row(key, *action)
            attempts = state[1] if state else 0
            state, action = apply_event(state, row.kind, row.at_us)
            if action:
                yield self._row(key, action, attempts, row.at_us)
        self._keep(before, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        before = tuple(self.job.get())
        state, action = overdue(before, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if action:
            yield self._row(key, *action)
            self.job.update(state)

    def _keep(self, before: tuple | None, state: tuple | None) -> None:
        old, new = (_timer(s) for s in (before, state))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if state is not None:
            self.job.update(state)
        elif before is not None:
            self.job.clear()

    @staticmethod
    def _row(key, action: str, attempts: int, at: int) -> Row:
        return Row(job_id=key[0], action=action, attempts=attempts, at_us=at)

    def close(self) -> None:
        pass


def _timer(state: tuple | None) -> int | None:
    return None if state is None or state[2] is None else -(-state[2] // 1000)


def worker_actions(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The actions of a stream of (event_id, job_id, kind, at): (job_id, action, attempts, at_us).

    Open jobs are the only state. Needs the RocksDB state store (``STATE_STORE``).
    """
    rows = events.withColumn("at_us", F.unix_micros("at")).withWatermark("at", watermark)
    return rows.groupBy("job_id").transformWithState(WorkerLoop(), OUTPUT, "append", "eventTime")
