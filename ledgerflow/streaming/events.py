"""Job events as streams: one schema, dedupe with a watermark, lifecycle state, running spend, and a reconciliation table kept fresh."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checks import reconcile_totals, statement_totals
from ..operators.scan import scan
from ..sources.keyed import KeyedTable
from ..sources.scratch import delete, stored

EVENT = "job_id string, ts timestamp, event string, data string"
DONE, FAILED = "done", "error"
# The keys of an event's one-line summary.
SUMMARY_KEYS = ("label", "count", "bank", "last4", "period", "issues", "ok", "error", "elapsed_s", "statement_count", "by_kind")


def event_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The append-only event log as a stream: what is there, then what arrives."""
    reader = spark.readStream.schema(EVENT)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def dedupe_events(df: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop repeats of a job's event and data; state is kept for the watermark on a stream, a batch looks at all rows."""
    if df.isStreaming:
        return df.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id", "event", "data"])
    first = F.min_by(F.struct(*df.columns), "ts")
    return df.groupBy(F.col("job_id").alias("_j"), F.col("event").alias("_e"), F.col("data").alias("_d")).agg(first.alias("r")).select("r.*")


def job_lifecycle(df: DataFrame) -> DataFrame:
    """job_id, status, started_at, finished_at, n_events, error: events after the job's end, and those without a time, are ignored. Batch form."""
    df = df.where(F.col("ts").isNotNull())
    w = Window.partitionBy("job_id").orderBy("ts", "event", "data").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("event").isin(DONE, FAILED)
    d = df.withColumn("_over", F.coalesce(F.max(ends.cast("int")).over(w), F.lit(0))).where("_over = 0")
    g = d.groupBy("job_id").agg(
        F.min("ts").alias("started_at"), F.max(F.when(ends, F.col("ts"))).alias("finished_at"), F.count("*").alias("n_events"),
        F.max(F.when(F.col("event") == DONE, 1)).alias("_done"), F.max(F.when(F.col("event") == FAILED, F.col("data"))).alias("error"),
    )
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_done") == 1, "done").when(F.col("n_events") > 1, "running").otherwise("pending")
    return g.select("job_id", status.alias("status"), "started_at", "finished_at", "n_events", "error")


LIFECYCLE = "job_id string, status string, started_at timestamp, finished_at timestamp, n_events long, error string"


def job_lifecycle_stream(df: DataFrame, ttl_ms: int = 3_600_000, watermark: str = "1 hour") -> DataFrame:
    """The stream twin: an updated row whenever a job gets events, its state dropped once the watermark is ttl_ms past the last of them.

    Time is that of the events, so a stream that has read all there is comes to its end. Events behind the watermark are late and dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = (None, None, 0, None, False, 0)
        started, finished, n, error, done, until = state.get if state.exists else fresh
        if until <= state.getCurrentWatermarkMs():  # events that come with the timeout are handed over in its place
            started, finished, n, error, done, until = fresh
        rows = pd.concat(list(batches)).sort_values(["ts", "event", "data"])
        for ts, event, data in zip(rows["ts"], rows["event"], rows["data"], strict=True):
            if finished is not None:
                break
            at = ts.value // 1000
            started, n = at if started is None else started, n + 1
            if event in (DONE, FAILED):
                finished, done, error = at, event == DONE, data if event == FAILED else None
        last = int(rows["ts"].max().value // 1_000_000)
        until = max(until, last + ttl_ms, state.getCurrentWatermarkMs() + ttl_ms)
        state.update((started, finished, n, error, done, until))
        state.setTimeoutTimestamp(until)
        status = "failed" if error is not None else "done" if done else "running" if n > 1 else "pending"
        stamp = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "started_at": [stamp(started)], "finished_at": [stamp(finished)], "n_events": [n], "error": [error]})

    held = "started long, finished long, n long, error string, done boolean, until long"
    timed = df.where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    return timed.groupBy("job_id").applyInPandasWithState(step, LIFECYCLE, held, "update", GroupStateTimeout.EventTimeTimeout)


def event_elapsed(df: DataFrame) -> DataFrame:
    """elapsed_s since the job's first event, and a one-line summary of the known keys in the data."""
    w = Window.partitionBy("job_id")
    micros = F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(w)
    held = df.withColumn("_d", F.from_json("data", "map<string, string>"))  # parsed once; what is no object has no line
    parts = [F.when(F.col("_d")[k].isNotNull(), F.concat(F.lit(k + "="), F.col("_d")[k])) for k in SUMMARY_KEYS]
    line = F.concat_ws(" ", *parts)
    return held.withColumns({"elapsed_s": F.floor((micros + 5000) / 10_000) / 100, "summary": F.when(line != "", line).otherwise(F.col("data"))}).drop("_d")


def job_ttl_evict(jobs: DataFrame, now, ttl_seconds: int = 3600, max_jobs: int = 1024) -> DataFrame:
    """Jobs that stay: unfinished ones, and finished ones within the time to live; beyond max_jobs the oldest finished go."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("finished_at").cast("double")
    live = jobs.where(F.col("finished_at").isNull() | (age <= ttl_seconds))
    open_ = live.where(F.col("finished_at").isNull())
    room = open_.agg(F.greatest(F.lit(0), max_jobs - F.count("*")).alias("_room"))  # one row
    newest = live.where(F.col("finished_at").isNotNull()).orderBy(F.desc("finished_at"), "job_id").limit(max_jobs)
    newest = newest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("finished_at"), "job_id")))  # max_jobs rows at most
    return open_.unionByName(newest.join(F.broadcast(room), F.col("_n") <= F.col("_room")).drop("_n", "_room"))


def land_spend(batch: DataFrame, n: int, path: str, cap: float | None, warn: float = 0.8, buckets: int = 256) -> None:
    """Write the running spend of batch n under path/spend, and each budget's new sum to the table path/budgets.

    A prefix scan adds up the batch, so one budget takes all tasks; what budgets had spent before is one row each and is joined on.
    The table keeps the sum before the last batch too, so that a batch that runs again writes the same rows in the same place.
    """
    spark, runs = batch.sparkSession, f"{path}/runs/{n}"
    micros = F.round(F.coalesce("cost_usd", F.lit(0)).cast("double") * 1_000_000).cast("long")  # whole millionths, so sums are exact
    rows = batch.select("budget", "ts", "call_id", micros.alias("_micros")).withColumn("key", F.to_json(F.struct("budget")))  # a budget may be null
    d = scan(rows, ("key",), ("ts", "call_id"), {"_sum": F.col("_micros")}, number="_n", path=runs)
    table = KeyedTable(spark, f"{path}/budgets", "key", buckets)
    added = spark.read.schema("key string, _micros long").parquet(runs).groupBy("key").agg(F.sum("_micros").alias("_added"))
    if table.manifest():
        before = F.when(F.col("batch") < n, F.col("after")).otherwise(F.col("before"))
        added = added.join(table.read().select("key", before.alias("before")), "key", "left")
    else:
        added = added.withColumn("before", F.lit(None).cast("long"))
    added = stored(added.select("key", "before", (F.coalesce("before", F.lit(0)) + F.col("_added")).alias("after"), F.lit(n).cast("long").alias("batch")), f"{path}/added/{n}")
    total = F.coalesce("before", F.lit(0)) + F.col("_sum")
    past = lambda c: c / 1_000_000 >= F.lit(cap).cast("double") * warn
    was = F.when((F.col("_n") > 1) | F.col("before").isNotNull(), past(total - F.col("_micros"))).otherwise(False)
    spent = total / 1_000_000
    d = d.join(added, "key").select(
        "budget", "ts", "call_id", spent.alias("spent"), F.coalesce(past(total) & ~was, F.lit(False)).alias("warns"),
        F.coalesce(spent > F.lit(cap).cast("double"), F.lit(False)).alias("breach"),
    )
    d.write.mode("overwrite").parquet(f"{path}/spend/batch={n}")
    table.upsert(added)
    delete(spark, runs)
    delete(spark, f"{path}/added/{n}")


def streaming_spend(calls: DataFrame, path: str, checkpoint: str, cap: float | None, warn: float = 0.8, buckets: int = 256):
    """Start a query that writes the running spend of a stream of calls (budget, ts, call_id, cost_usd) under path: a row a call.

    warns where a call takes its budget past the share warn of cap; breach beyond cap is a row, not an error; no cap, no limit.
    Calls of a micro-batch are in order of ts and call_id, those of an earlier one stand before. A null cost is none.
    """
    land = lambda batch, n: land_spend(batch, n, path, cap, warn, buckets)
    return calls.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SPEND = "budget string, ts timestamp, call_id long, spent double, warns boolean, breach boolean"


def running_spend(spark: SparkSession, path: str, schema: str = SPEND) -> DataFrame:
    """What streaming_spend has written, with the batch of each row; schema names the types of the calls' columns."""
    if not KeyedTable(spark, f"{path}/budgets").versions():
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/spend")


def streaming_reconcile(s: DataFrame, t_stream: DataFrame, path: str, checkpoint: str, buckets: int = 256):
    """Start a query that keeps the reconciliation of all statements seen under path, as a table by statement (see KeyedTable).

    The stream's state holds each statement's sums and counts, and a batch adds what its own rows change; no earlier row is read
    again. A row whose sign is -1 takes back an equal row of before, so a correction is two rows: the old one with -1, the new one
    with 1. Without a column sign all rows count as 1. A batch that runs again finds the same totals and writes the same rows.
    """
    sign = F.coalesce(F.col("sign"), F.lit(1)) if "sign" in t_stream.columns else F.lit(1)
    totals = statement_totals(t_stream, sign)

    def land(batch: DataFrame, n: int) -> None:
        fresh = batch.persist()
        try:
            known = s.join(fresh.select("statement_id"), "statement_id", "left_semi")
            found = reconcile_totals(known, fresh).withColumn("batch", F.lit(n).cast("long"))
            KeyedTable(batch.sparkSession, f"{path}/reconciliation", "statement_id", buckets).upsert(found)
        finally:
            fresh.unpersist()

    return totals.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_reconciliation(spark: SparkSession, path: str) -> DataFrame:
    """The row of each statement as of the last batch."""
    return KeyedTable(spark, f"{path}/reconciliation", "statement_id").read().drop("batch")


def event_row(job_id: str, ts: str, event: str, **data) -> str:
    return json.dumps({"job_id": job_id, "ts": ts, "event": event, "data": json.dumps(data)})
