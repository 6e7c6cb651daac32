"""Job states inside a stream: value state and timers by transformWithState; a stored board of live jobs with time to live and limit."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyed import KeyedTable
from .events import DONE, FAILED

JOB = "job_id string, status string, started_at timestamp, finished_at timestamp, n_events long, error string"
EVICTED, TIMED_OUT = "evicted", "timed out"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class JobStates(StatefulProcessor):
    """A job's state, and one timer: a finished job goes ttl_ms after its end, an unfinished one timeout_ms after its last event.

    A row comes out whenever events come in, and one with the status evicted or timed out when the timer fires; then the state is gone.
    """

    def __init__(self, ttl_ms: int, timeout_ms: int):
        self.ttl_ms, self.timeout_ms = ttl_ms, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, finished long, last long, n long, failed boolean, error string")

    def _row(self, job_id: str, status: str, held: tuple) -> Row:
        started, finished, _, n, _, error = held
        stamp = lambda us: None if us is None else datetime.fromtimestamp(us / 1_000_000, timezone.utc)
        return Row(job_id=job_id, status=status, started_at=stamp(started), finished_at=stamp(finished), n_events=n, error=error)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, finished, last, n, failed, error = tuple(self.job.get()) if self.job.exists() else (None, None, 0, 0, False, None)
        for at, event, data in sorted((r["at"], r["event"] or "", r["data"] or "") for r in rows):
            if finished is None:
                started, n, last = at if started is None else started, n + 1, max(last, at)
                if event in (DONE, FAILED):
                    finished, failed, error = at, event == FAILED, data if event == FAILED else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((finished // 1000 + self.ttl_ms) if finished is not None else (last // 1000 + self.timeout_ms))
        held = (started, finished, last, n, failed, error)
        self.job.update(held)
        yield self._row(key[0], "failed" if failed else "done" if finished is not None else "running" if n > 1 else "pending", held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            held = tuple(self.job.get())
            self.job.clear()
            yield self._row(key[0], EVICTED if held[1] is not None else TIMED_OUT, held)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, ttl_seconds: int = 3600, timeout_seconds: int = 86_400, watermark: str = "1 hour") -> DataFrame:
    """Rows of JOB from an event stream (see JobStates). Events without a time, and those behind the watermark, are left out.

    The session's state store must be RocksDB's when the stream starts (job_board sees to that).
    """
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("job_id").transformWithState(JobStates(ttl_seconds * 1000, timeout_seconds * 1000), JOB, "Update", "EventTime")


def job_board(events: DataFrame, path: str, checkpoint: str, ttl_seconds: int = 3600, timeout_seconds: int = 86_400, max_jobs: int = 1024, watermark: str = "1 hour", buckets: int = 64):
    """Start a query that keeps a table of the jobs that live under path (see KeyedTable), as job_ttl_evict keeps them of a batch.

    Evicted and timed out jobs leave the table when their timer fires; beyond max_jobs the oldest finished ones leave it. A batch
    that runs again changes nothing.
    """
    spark = events.sparkSession

    def land(batch: DataFrame, n: int) -> None:
        table = KeyedTable(batch.sparkSession, path, "job_id", buckets)
        rows = batch.withColumn("gone", F.col("status").isin(EVICTED, TIMED_OUT)).persist()
        try:
            # A job whose timer fires in the batch that also brings it events has two rows: events come first.
            last = rows.groupBy("job_id").agg(F.max_by(F.struct(*rows.columns), F.struct("gone", "n_events")).alias("r")).select("r.*")
            table.upsert(last.where("not gone").drop("gone"))
            table.delete(last.where("gone"))
        finally:
            rows.unpersist()
        over = table.read().count() - max_jobs
        if over > 0:
            ended = table.read().where(F.col("finished_at").isNotNull()).orderBy("finished_at", F.desc("job_id")).limit(over)
            table.delete(ended)
        table.vacuum()

    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)
    try:
        return job_states(events, ttl_seconds, timeout_seconds, watermark).writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_ROCKS[0], before)


def live_jobs(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(spark, path, "job_id").read()
