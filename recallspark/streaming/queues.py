"""Each tenant's queue of jobs as a stream: commands come in, changes of state go out.

Jobs are put, claimed in the order in which they were put, and done. A job that has been running for as long
as ``timeout`` goes back to the queue, at its old place, or fails for good when it has had its attempts. That
happens at the job's own time: a command at or after it finds the job pending again, and where no command
comes a timer of event time tells. So what goes out does not depend on how commands were cut into batches.

Commands of one tenant that are in one batch are taken in order of ``seq``; rows behind the watermark are
dropped. State holds a tenant's open jobs only. A run that is started anew goes on from what was kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "tenant long, job_id long, status string, at timestamp, attempts int"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Jobs:
    """A tenant's open jobs and what happens to them, in microseconds: ``open`` maps a job to status, since, attempts, place."""

    def __init__(self, open_: dict[int, tuple[str, int, int, int]], timeout: int, most: int) -> None:
        self.open, self.timeout, self.most = open_, timeout, most
        self.changes: list[tuple[int, str, int, int]] = []
        # Heaps by place, and of ends of running jobs; entries that no longer hold are passed over when they are met.
        self.places = {status: [(p, j) for j, (s, _, _, p) in open_.items() if s == status] for status in ("pending", "running")}
        self.ends = [(since + timeout, j) for j, (s, since, _, _) in open_.items() if s == "running"]
        for heap in (*self.places.values(), self.ends):
            heapify(heap)

    def put(self, job: int, status: str, at: int, attempts: int, place: int) -> None:
        self.open[job] = (status, at, attempts, place)
        self.changes.append((job, status, at, attempts))
        heappush(self.places[status], (place, job))
        if status == "running":
            heappush(self.ends, (at + self.timeout, job))

    def first(self, status: str) -> int | None:
        """The job of least place that has the status."""
        heap = self.places[status]
        while heap:
            place, job = heap[0]
            if job in self.open and self.open[job][0] == status and self.open[job][3] == place:
                return job
            heappop(heap)
        return None

    def next_end(self) -> int | None:
        """When the first of the running jobs times out."""
        while self.ends:
            end, job = self.ends[0]
            if job in self.open and self.open[job][0] == "running" and self.open[job][1] + self.timeout == end:
                return end
            heappop(self.ends)
        return None

    def expire(self, now: int) -> None:
        while (at := self.next_end()) is not None and at <= now:
            job = heappop(self.ends)[1]
            _, _, attempts, place = self.open[job]
            if attempts >= self.most:
                del self.open[job]
                self.changes.append((job, "failed", at, attempts))
            else:
                self.put(job, "pending", at, attempts, place)

    def take(self, op: str, job: int | None, at: int, place: int) -> None:
        self.expire(at)
        if op == "put":
            if job is not None and job not in self.open:
                self.put(job, "pending", at, 0, place)
        elif op == "claim":
            if (job := self.first("pending")) is not None:
                _, _, attempts, place = self.open[job]
                self.put(job, "running", at, attempts + 1, place)
        elif op == "done":
            job = self.first("running") if job is None else job
            if job in self.open and self.open[job][0] == "running":
                self.changes.append((job, "completed", at, self.open.pop(job)[2]))


class QueueProcessor(StatefulProcessor):
    def __init__(self, timeout_minutes: int, most: int) -> None:
        self.timeout, self.most = timeout_minutes * 60_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A list is written in one call, a map in one for each job.
        self.jobs = handle.getListState("open_jobs", "job_id long, status string, since long, attempts int, place long")

    def _read(self) -> tuple[dict, Jobs]:
        before = {job: tuple(state) for job, *state in self.jobs.get()}
        return before, Jobs(dict(before), self.timeout, self.most)

    def _kept(self, tenant: int, before: dict, now: Jobs) -> Iterator[pd.DataFrame]:
        if now.open and now.open != before:
            self.jobs.put([(job, *state) for job, state in now.open.items()])
        elif before and not now.open:
            self.jobs.clear()
        # One timer, for the first that times out: when it comes, it tells all that have, and sets the next.
        if (end := now.next_end()) is not None:
            self.handle.registerTimer(-(-end // 1000))
        if now.changes:
            out = pd.DataFrame(now.changes, columns=["job_id", "status", "at", "attempts"])
            out["at"] = pd.to_datetime(out["at"], unit="us")
            out.insert(0, "tenant", tenant)
            yield out.astype({"attempts": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, now = self._read()
        commands = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for op, job, us, place in zip(commands["op"], commands["job_id"], commands["us"], commands["seq"]):
            now.take(op, None if pd.isna(job) else int(job), int(us), int(place))
        yield from self._kept(key[0], before, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before, now = self._read()
        now.expire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000)
        yield from self._kept(key[0], before, now)


def queue(commands: DataFrame, timeout_minutes: int = 10, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """``CHANGES`` of a stream of commands: tenant, seq, at, op (put, claim, done), job_id.

    ``done`` without a job ends the one that was put first of those running. The session has to keep state in
    RocksDB while the query starts, see ``kept_in_rocks``.
    """
    rows = commands.withWatermark("at", late).selectExpr("tenant", "seq", "at", "unix_micros(at) AS us", "op", "job_id")
    return rows.groupBy("tenant").transformWithStateInPandas(QueueProcessor(timeout_minutes, most), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


@contextmanager
def kept_in_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
