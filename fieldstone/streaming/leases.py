"""Jobs as a stream of events: leases that expire, retries after a delay, and jobs that die, with state and timers.

An event (job_id, at, event) is ENQUEUED, CLAIMED, SUCCEEDED or FAILED. A claim holds a job for a lease; when that runs out the job is queued again. A
failed job is queued again after a delay, or is DEAD after its last attempt. Events that don't fit a job's state change nothing. Events wait in state until
the watermark has passed them, so they may arrive in any order within its delay; timers bring them, and the ends of leases, in order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.schedule import MOST_ATTEMPTS

#: Minutes of a lease, and seconds until a failed job is due again.
LEASE_MINUTES, DELAY_SECONDS = 30, 60
#: What a state store must be for timers and lists.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGES = "job_id {kind}, ms long, status string, attempts int, reason string"
JOB = "status string, attempts int, since long"

State = tuple[str | None, int, int]
Change = tuple[int, str, int, str]


def expired(state: State, now: int, lease: int) -> tuple[State, list[Change]]:
    """The job after its lease, if that has run out by now (milliseconds)."""
    status, attempts, since = state
    if status == "RUNNING" and since + lease <= now:
        return ("QUEUED", attempts, since + lease), [(since + lease, "QUEUED", attempts, "LEASE_EXPIRED")]
    return state, []


def applied(state: State, at: int, event: str, lease: int, delay: int, most: int) -> tuple[State, list[Change]]:
    """The job after an event, and its changes; since is when a running job was claimed, and when a queued one is due."""
    state, changes = expired(state, at, lease)
    status, attempts, since = state
    match event, status:
        case "ENQUEUED", None | "SUCCEEDED" | "DEAD":
            state = ("QUEUED", 0, at)
        case "CLAIMED", "QUEUED" if since <= at:
            state = ("RUNNING", attempts + 1, at)
        case "SUCCEEDED", "RUNNING":
            state = ("SUCCEEDED", attempts, at)
        case "FAILED", "RUNNING":
            state = ("DEAD", attempts, at) if attempts >= most else ("QUEUED", attempts, at + delay)
        case _:
            return state, changes
    return state, [*changes, (at, state[0], state[1], event)]


def frame(job_id: object, changes: list[Change]) -> pd.DataFrame:
    at, status, attempts, reason = zip(*changes, strict=True) if changes else ((),) * 4
    plain = lambda values: pd.Series(list(values), dtype=object)  # noqa: E731  (texts as objects: state's serialiser takes no chunked arrays)
    return pd.DataFrame({"job_id": plain([job_id] * len(changes)), "ms": pd.Series(list(at), dtype="int64"), "status": plain(status), "attempts": pd.Series(list(attempts), dtype="int32"), "reason": plain(reason)})


class Jobs(StatefulProcessor):
    """A job's state, its events that the watermark hasn't passed yet, and timers for these and for the end of its lease."""

    def __init__(self, lease: int, delay: int, most: int):
        self.rule = (lease, delay, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.waiting = handle.getListState("waiting", "at long, event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), event) for part in rows for at, event in zip(part["ms"], part["event"], strict=True)]
        self.waiting.appendList(new)
        for at in {at for at, _ in new}:
            self.handle.registerTimer(at)
        yield frame(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()  # all up to it is in: what it has passed is settled at once, whichever timer comes first
        state: State = tuple(self.job.get()) if self.job.exists() else (None, 0, 0)
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        changes: list[Change] = []
        for at, event in sorted(x for x in held if x[0] <= now):
            state, more = applied(state, at, event, *self.rule)
            changes += more
        state, more = expired(state, now, self.rule[0])
        left = [x for x in held if x[0] > now]
        if len(left) < len(held):
            self.waiting.put(left) if left else self.waiting.clear()
        if state[0] == "RUNNING":
            self.handle.registerTimer(state[2] + self.rule[0])
        if state[0] is not None:
            self.job.update(state)
        yield frame(key[0], changes + more)

    def close(self) -> None:
        pass


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """The session with STORE, as long as it lasts."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changes(events: DataFrame, late: str = "1 hour", lease_minutes: int = LEASE_MINUTES, delay_seconds: int = DELAY_SECONDS, most: int = MOST_ATTEMPTS) -> DataFrame:
    """job_id, at, status, attempts and reason of each change of a stream of events (job_id, at, event). The session's state store must be that of STORE when it starts: see store()."""
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", "at", F.unix_millis("at").alias("ms"), "event").withWatermark("at", late).groupBy("job_id")
    return timed(rows.transformWithStateInPandas(Jobs(lease_minutes * 60_000, delay_seconds * 1000, most), CHANGES.format(kind=kind), "Append", "EventTime"))


def timed(found: DataFrame) -> DataFrame:
    return found.select("job_id", F.timestamp_millis("ms").alias("at"), "status", "attempts", "reason")


def changes_by_batch(events: DataFrame, until: str, lease_minutes: int = LEASE_MINUTES, delay_seconds: int = DELAY_SECONDS, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The same from a table of events, up to a time in UTC."""
    kind, end = events.schema["job_id"].dataType.simpleString(), int(pd.Timestamp(until).value // 1_000_000)
    lease, delay = lease_minutes * 60_000, delay_seconds * 1000

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        state, out = (None, 0, 0), []
        for at, event in sorted((int(a), e) for a, e in zip(group["ms"], group["event"], strict=True)):
            if at <= end:
                state, more = applied(state, at, event, lease, delay, most)
                out += more
        return frame(key[0], out + expired(state, end, lease)[1])

    return timed(events.select("job_id", F.unix_millis("at").alias("ms"), "event").groupBy("job_id").applyInPandas(run, CHANGES.format(kind=kind)))
