"""Export-job lifecycle over an event log, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

C = F.col
FINISHED = ("succeeded", "failed", "canceled")


def job_outcomes(events: DataFrame) -> DataFrame:
    """Final state of each job: queued -> running -> succeeded or failed, or queued -> canceled; the first end sticks.

    Every step is the earliest fitting event after the step before, so a job is never gathered into one list, however
    long its log.
    """
    def first(after: DataFrame, since: str, statuses: tuple[str, ...], name: str) -> DataFrame:
        later = events.where(C("status").isin(*statuses)).join(after.select("job_id", since), "job_id").where(F.struct("ts", "event_id") > C(since))
        return later.groupBy("job_id").agg(F.min(F.struct("ts", "event_id", "status")).alias(name))

    queued = events.where("status = 'queued'").groupBy("job_id").agg(F.min(F.struct("ts", "event_id")).alias("q"))
    run = first(queued, "q", ("running",), "_r").select("job_id", F.struct("_r.ts", "_r.event_id").alias("r"))
    stop = first(queued, "q", ("canceled",), "_c").select("job_id", F.struct("_c.ts", "_c.event_id").alias("c"))
    started = queued.join(run, "job_id", "left").join(stop, "job_id", "left").withColumn("_stopped", C("c").isNotNull() & (C("r").isNull() | (C("c") < C("r"))))
    running = started.where(C("r").isNotNull() & ~C("_stopped")).select("job_id", "r")
    done = first(running, "r", ("succeeded", "failed"), "d")
    joined = started.join(done, "job_id", "left")
    status = F.when(C("_stopped"), "canceled").when(C("d").isNotNull(), C("d.status")).when(C("r").isNotNull(), "running").otherwise("queued")
    return joined.select("job_id", status.alias("status"), C("q.ts").alias("queued_at"), F.when(~C("_stopped"), C("r.ts")).alias("running_at"),
                         F.when(C("_stopped"), C("c.ts")).otherwise(C("d.ts")).alias("finished_at"))


def job_timeouts(outcomes: DataFrame, seconds: int) -> DataFrame:
    """Jobs that ran longer than allowed, and when the limit passed."""
    limit = C("running_at") + F.make_dt_interval(secs=F.lit(seconds))
    ran = outcomes.where(C("running_at").isNotNull())
    return ran.where(C("finished_at").isNull() | (C("finished_at") > limit)).select("job_id", "running_at", limit.alias("timed_out_at"))


# times in microseconds; due is the event time in milliseconds at which the job's timer rings
STATE = "status string, queued_at bigint, running_at bigint, finished_at bigint, due bigint"
EVENT = "us bigint, event_id bigint, status string"
OUTPUT = "job_id bigint, status string, queued_at bigint, running_at bigint, finished_at bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 4096
ALWAYS, NEVER = (float("-inf"), 0), (float("inf"), 0)

# what a job waits for in each state; the status it then has is that of the event
NEXT = {None: ("queued",), "queued": ("running", "canceled"), "running": FINISHED[:2]}


def _advance(state: tuple, status: str, us: int) -> tuple:
    """The state after an event it waits for."""
    _, queued, running, _ = state
    if status == "queued":
        return status, us, None, None
    return (status, queued, us, None) if status == "running" else (status, queued, running, us)


class JobStates(StatefulProcessor):
    """State of each job, moved by the earliest event it waits for.

    The events of a batch come in no order and may be any number.  They are read as an iterator; those the job may still need after
    its first step are put aside in a state list, which is read again once for each further step, so a task holds a chunk of
    events and never the log of a job.  Timers end jobs that wait too long and clear finished jobs: event-time state knows no
    time to live of its own.
    """

    def __init__(self, limit_us: int, queue_limit_us: int):
        self.limit, self.queue_limit = limit_us, queue_limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.aside = handle.getListState("aside", EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.job.get() if self.job.exists() else (None,) * 5
        state, due = tuple(stored[:4]), stored[4]
        before = state
        if state[0] not in FINISHED:
            state = self._follow(state, ((r.us, r.event_id, r.status) for r in rows))
        if state[0] is not None and state != before:
            self._store(state, due, timerValues.getCurrentWatermarkInMs())
            yield Row(job_id=key[0], status=state[0], queued_at=state[1], running_at=state[2], finished_at=state[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        status, queued, running, finished, due = self.job.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status in FINISHED:
            self.job.clear()
            return
        end = ("canceled", queued, None, queued + self.queue_limit) if status == "queued" else ("failed", queued, running, running + self.limit)
        self._store(end, None, timerValues.getCurrentWatermarkInMs())
        yield Row(job_id=key[0], status=end[0], queued_at=end[1], running_at=end[2], finished_at=end[3])

    def close(self) -> None:
        pass

    def _follow(self, state: tuple, events) -> tuple:
        """The state after all steps that the events of a batch allow."""
        step, chunk = None, []
        # latest time at which the job can take each step, as far as read: later events of that kind are never taken
        queued = NEVER if state[0] is None else ALWAYS
        bound = {"running": ALWAYS if state[0] == "running" else NEVER, "canceled": NEVER, "end": NEVER}
        for event in events:
            at, status = event[:2], event[2]
            if status in NEXT[state[0]] and (step is None or at < step[:2]):
                step = event
            if status == "queued":
                queued = min(queued, at)
                continue
            kind = "end" if status in NEXT["running"] else status
            if kind not in bound or at > bound[kind]:
                continue
            if at > (bound["running"] if kind == "end" else queued):
                bound[kind] = at
            chunk.append(event)
            if len(chunk) == CHUNK:
                self.aside.appendList(chunk)
                chunk = []
        if chunk:
            self.aside.appendList(chunk)
        while step is not None:
            state, at, step = _advance(state, step[2], step[0]), step[:2], None
            if state[0] in FINISHED:
                break
            for us, event_id, status in self.aside.get():
                if status in NEXT[state[0]] and at < (us, event_id) and (step is None or (us, event_id) < step[:2]):
                    step = (us, event_id, status)
        self.aside.clear()
        return state

    def _store(self, state: tuple, due: int | None, watermark: int) -> None:
        if due is not None:
            self.handle.deleteTimer(due)
        status, queued, running, finished = state
        # a finished job keeps a small row for a while, so that late events cannot reopen it
        ends = queued + self.queue_limit if status == "queued" else running + self.limit if status == "running" else finished + self.limit
        ring = max(ends // 1000, watermark + 1)
        self.handle.registerTimer(ring)
        self.job.update((*state, ring))


def job_states_stream(events: DataFrame, timeout: str = "1 hour", watermark: str = "10 minutes", queue_timeout: str = "7 days") -> DataFrame:
    """Every change of a job's state.

    Finished jobs free their state, running ones fail when their time is up, and queued ones that never start are
    canceled after ``queue_timeout``, so no state stays for ever.  State lives in RocksDB, on the executors' disks.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    limit, queue_limit = (int(pd.Timedelta(t).total_seconds() * 1_000_000) for t in (timeout, queue_timeout))
    rows = events.where(C("job_id").isNotNull() & C("ts").isNotNull() & C("status").isNotNull()).withWatermark("ts", watermark).select(
        "job_id", "event_id", "status", "ts", F.unix_micros("ts").alias("us"))
    changes = rows.groupBy("job_id").transformWithState(JobStates(limit, queue_limit), OUTPUT, "Update", "EventTime")
    return changes.select("job_id", "status", *[F.timestamp_micros(n).alias(n) for n in ("queued_at", "running_at", "finished_at")])
