from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.checks import reconcile
from ledgerflow.plans import ledger
from ledgerflow.sources import files
from ledgerflow.streaming import events

SF = "/root/testdata/sf0.001"


def test_sniff(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7", "b.png": b"\x89PNG\r\n\x1a\n0", "c.xlsx": b"PK\x03\x04..", "d.htm": b"x", "e.bin": b"<!DOCTYPE html>", "f.txt": b"\xff\xfe\xfa", "g.dat": b"\xff\xfe\xfa", "h.dat": b"plain", "i.dat": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.sniff_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.png": "image", "c.xlsx": "xlsx", "d.htm": "html", "e.bin": "html", "f.txt": "text", "g.dat": "unknown", "h.dat": "text", "i.dat": "empty"}


def test_text_and_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one\ntwo")
    (tmp_path / "t/b.txt").write_text("  \n")
    assert [r["text"] for r in files.read_text_documents(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]
    one = {"account": {"bank": "B", "account_last4": "4664", "period": {"start": "2025-04-01", "end": "2025-04-30"}}, "summary": {"beginning_balance": 1.5, "ending_balance": 2.5, "deposits_total": 1, "withdrawals_total": 0, "deposits_count": 1}, "transactions": [{"date": "2025-04-03", "description": "z", "deposit": 1.0}, {"date": "bad", "description": "a, \"q\"", "withdrawal": 2}], "_anomalies": [{"kind": "k", "severity": "warn", "message": "m", "transaction_index": 1}]}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/s.json").write_text(json.dumps([one, one]))
    parts = files.explode_statements(files.read_statements_json(spark, str(tmp_path / "j")))
    assert parts["statements"].count() == 2 and parts["anomalies"].count() == 2
    t = parts["transactions"].orderBy("statement_id", "tx_index").collect()
    assert [(r["tx_index"], r["description"]) for r in t[:2]] == [(0, "z"), (1, 'a, "q"')] and t[1]["tx_date"] is None
    nested = files.nest_statements(*[parts[n] for n in ("statements", "transactions", "reconciliation", "anomalies", "recurring")])
    files.write_statements_json(nested, str(tmp_path / "out"), first=True)
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert len(back) == 1 and [x["description"] for x in back[0]["transactions"]] == ["z", 'a, "q"']
    files.write_transactions_csv(parts["transactions"].withColumn("statement_id", F.lit("s")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).where("description = 'a, \"q\"'").count() == 2


def _log(spark, folder, rows):
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join(events.event_row(*r) for r in rows))


ROWS = [("j", "2025-01-01 00:00:00", "queued"), ("j", "2025-01-01 00:00:01", "ingest_start"), ("j", "2025-01-01 00:00:01", "ingest_start"), ("j", "2025-01-01 00:00:02", "done"), ("j", "2025-01-01 00:00:03", "late"), ("k", "2025-01-01 00:00:00", "queued"), ("k", "2025-01-01 00:00:09", "error")]


def _run(df, mode, name):
    # What is there, then stop.
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    _log(spark, tmp_path / "log", ROWS)
    batch = spark.read.schema(events.EVENT).json(str(tmp_path / "log"))
    key = lambda df: sorted((r["job_id"], str(r["ts"]), r["event"]) for r in df.collect())
    _run(events.dedupe_events(events.event_source(spark, str(tmp_path / "log"))), "append", "deduped")
    assert key(spark.table("deduped")) == key(events.dedupe_events(batch)) and spark.table("deduped").count() == 6
    _run(events.job_lifecycle_stream(events.event_source(spark, str(tmp_path / "log"))), "update", "jobs")
    look = lambda df: sorted((r["job_id"], r["status"], str(r["started_at"]), str(r["finished_at"]), r["n_events"]) for r in df.collect())
    assert look(spark.table("jobs")) == look(events.job_lifecycle(batch))
    assert {r["job_id"]: r["status"] for r in events.job_lifecycle(batch).collect()} == {"j": "done", "k": "failed"}


@pytest.mark.parametrize("quiet", [True, False])
def test_state_expires(spark, tmp_path, quiet):
    """An event long after a job's last one finds its state gone: the job begins anew, whether or not a batch lies between."""
    folder = tmp_path / "log"
    folder.mkdir()
    between = [[("x", "2025-01-02 01:00:00", "go")]] if quiet else []
    for i, rows in enumerate([[("j", "2025-01-01 00:00:00", "queued"), ("j", None, "no time")], [("x", "2025-01-02 00:00:00", "queued")], *between, [("j", "2025-01-02 02:00:00", "queued")]]):
        file = folder / f"{i}.json"
        file.write_text("\n".join(events.event_row(*r) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their times
    name = f"expired_{quiet}".lower()
    _run(events.job_lifecycle_stream(events.event_source(spark, str(folder), 1), ttl_ms=60_000, watermark="1 minute"), "update", name)
    want = [("j", 1, "pending"), ("j", 1, "pending"), ("x", 1, "pending")]
    assert sorted((r["job_id"], r["n_events"], r["status"]) for r in spark.table(name).collect()) == want + [("x", 2, "running")] * quiet


def test_streaming_spend(spark, tmp_path):
    calls = spark.createDataFrame([("b", 1, i, 3.0) for i in range(4)], "budget string, ts long, call_id long, cost_usd double")
    calls.write.parquet(str(tmp_path / "calls"))
    out, schema = str(tmp_path / "out"), events.SPEND.replace("timestamp", "long")
    assert events.running_spend(spark, out).count() == 0
    events.streaming_spend(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), out, str(tmp_path / "cp"), 10.0).awaitTermination()
    got = [(r["spent"], r["warns"], r["breach"]) for r in events.running_spend(spark, out, schema).orderBy("spent").collect()]
    assert got == [(3.0, False, False), (6.0, False, False), (9.0, True, False), (12.0, False, True)]


def test_running_spend_over_batches(spark, tmp_path, request):
    """A hot budget lies in many partitions; a batch that runs again changes nothing; null budgets and costs, no cap."""
    schema = "budget string, ts long, call_id long, cost_usd double"
    rnd = random.Random(3)
    batches = [[(rnd.choice(["hot"] * 8 + ["b", None]), rnd.randint(0, 99), n * 10**6 + i, rnd.choice([None, 0.25, 0.000001, 1.5])) for i in range(3000)] for n in range(3)]
    out, state, expected = str(tmp_path), {}, {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # so that small partitions stay apart and can be counted
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    for n, rows in enumerate(batches):
        d = spark.createDataFrame(rows, schema)
        events.land_spend(d, n, out, 1000.0, buckets=4)
        events.land_spend(d, n, out, 1000.0, buckets=4)
        for budget, _, call, cost in sorted(rows, key=lambda r: (r[1], r[2])):
            was = state.get(budget, 0)
            now = state[budget] = was + round((cost or 0) * 10**6)
            expected[call] = (budget, now / 10**6, now >= 800 * 10**6 > was, now > 1000 * 10**6)
    found = events.running_spend(spark, out, events.SPEND.replace("timestamp", "long"))
    assert {r["call_id"]: (r["budget"], r["spent"], r["warns"], r["breach"]) for r in found.collect()} == expected
    assert found.count() == len(expected) and sum(w for _, _, w, _ in expected.values()) >= 1
    assert found.where("budget = 'hot' AND batch = 0").select(F.input_file_name()).distinct().count() > 1
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == []
    events.land_spend(spark.createDataFrame(batches[0], schema), 0, free := str(tmp_path / "free"), None, buckets=4)
    assert events.running_spend(spark, free, events.SPEND.replace("timestamp", "long")).where("warns OR breach").count() == 0


def test_streaming_reconcile(spark, tmp_path):
    t = ledger.transactions(spark, SF)
    s = ledger.statements(spark, t)
    t.drop("account_last4").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.drop("account_last4").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.streaming_reconcile(s, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["statement_id"]: r["ok"] for r in events.latest_reconciliation(spark, str(tmp_path / "out")).collect()}
    assert got == {r["statement_id"]: r["ok"] for r in reconcile(s, t).collect()}


def test_job_eviction(spark):
    jobs = spark.createDataFrame([("a", None), ("b", "2025-01-01 00:00:00"), ("c", "2025-01-01 11:30:00"), ("d", "2025-01-01 11:50:00")], "job_id string, f string").select("job_id", F.col("f").cast("timestamp").alias("finished_at"))
    assert {r["job_id"] for r in events.job_ttl_evict(jobs, "2025-01-01 12:00:00").collect()} == {"a", "c", "d"}
    assert {r["job_id"] for r in events.job_ttl_evict(jobs, "2025-01-01 12:00:00", max_jobs=2).collect()} == {"a", "d"}
