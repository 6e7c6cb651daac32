"""Prefix scans over many runs, exact quantiles, the copy-on-write table, quarantine of broken files; kept-up stream results."""

from __future__ import annotations

import json
import os
import random
import statistics
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import analytics, checks, forensic, stores
from ledgerflow.operators.quantile import exact_quantile
from ledgerflow.operators.scan import scan
from ledgerflow.plans import ledger
from ledgerflow.sources import files
from ledgerflow.sources.keyed import KeyedTable
from ledgerflow.streaming import events, jobs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_scan_of_groups_over_many_runs(spark, parts):
    rnd = random.Random(parts)
    rows = [("hot", i, rnd.choice([None, 1, 2, -3]), "clash") for i in range(3000)] + [(rnd.choice(["a", "b", None]), i, i, "clash") for i in range(60)] + [("lone", None, 5, "x"), ("nulls", 1, None, "x")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int, _n string").repartition(5)
    got = scan(df, ("g",), ("i",), {"total": F.col("v")}, {"before": F.col("v"), "before_i": F.col("i")}, "place", parts)
    assert got.columns == ["g", "i", "v", "_n", "total", "before", "before_i", "place"]
    want, groups = [], {}
    for g, i, v, _ in rows:
        groups.setdefault(g, []).append((-1 if i is None else i, i, v))
    for g, xs in groups.items():
        xs.sort()
        sums = list(accumulate(([v] if v is not None else [] for _, _, v in xs), lambda a, b: a + b))
        for k, (_, i, v) in enumerate(xs):
            want.append((g, i, v, sum(sums[k]) if sums[k] else None, xs[k - 1][2] if k else None, xs[k - 1][1] if k else None, k + 1))
    key = lambda r: (str(r[0]), r[6])
    assert sorted([(r["g"], r["i"], r["v"], r["total"], r["before"], r["before_i"], r["place"]) for r in got.collect()], key=key) == sorted(want, key=key)
    if parts == 16:  # one group takes many tasks
        inside = got.where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(inside) > 1
    assert scan(df.limit(0), ("g",), ("i",), {"total": F.col("v")}, number="place").count() == 0


def test_one_long_statement(spark):
    n = 20_000
    t = spark.range(n).select(F.lit("s").alias("statement_id"), F.col("id").cast("int").alias("tx_index"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") / 1000).cast("int")).alias("tx_date"), F.lit(1.5).cast("decimal(18,2)").alias("deposit"), F.when(F.col("id") % 2 == 1, 1).cast("decimal(18,2)").alias("withdrawal"))
    s = spark.createDataFrame([("s", "2025-01-01", 10.0)], "statement_id string, p string, b double").select("statement_id", F.col("p").cast("date").alias("period_start"), F.col("b").cast("decimal(18,2)").alias("beginning_balance"))
    got = analytics.running_balance(s, t)
    assert got.count() == n + 1 and got.where(f"point = {n}").first()["balance"] == 10 + 1.5 * n - n // 2
    assert got.where("point = 3").first()["balance"] == 10 + 4.5 - 1
    report = spark.range(500).select(F.lit("r").alias("report_id"), F.col("id").cast("string").alias("statement_id"), F.col("id").alias("doc_pos"), (F.col("id") + F.when(F.col("id") == 400, 1).otherwise(0)).cast("decimal(18,2)").alias("beginning_balance"), (F.col("id") + 1).cast("decimal(18,2)").alias("ending_balance"))
    status = {r["statement_id"]: r["status"] for r in analytics.cover_continuity(report).collect()}
    assert status.pop("0") is None and status.pop("400") == "DRIFT $1.00" and set(status.values()) == {"OK"}


def test_exact_quantile(spark):
    rnd = random.Random(8)
    groups = {"hot": [rnd.choice([0.01 * k for k in range(-300, 900)]) for _ in range(4000)], "same": [7.0] * 999, "one": [3.0], "two": [1.0, 2.0], "wide": [10.0**k * s for k in range(-300, 300, 7) for s in (1, -1)], None: [5.0, 6.0, 6.5]}
    df = spark.createDataFrame([(g, v, i % 3) for g, vs in groups.items() for i, v in enumerate(vs)] + [("empty", None, 1), ("two", None, 1)], "g string, v double, _n int")
    got = {r["g"]: r["m"] for r in exact_quantile(df, ("g",), F.col("v"), name="m").collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    for q in (0.0, 0.1, 0.77, 1.0):
        ours = {r["g"]: r["m"] for r in exact_quantile(df, ("g",), F.col("v"), q, "m").collect()}
        want = {r["g"]: r["m"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", q).alias("m")).collect()}
        assert ours.keys() == want.keys() and all(abs(ours[k] - want[k]) <= 1e-9 * abs(want[k]) for k in ours)
    plan = exact_quantile(df, ("g",), F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ollect" not in plan.replace("CollectMetrics", "")


def test_recurring_rank(spark):
    rows = [(i, f"2025-0{1 + i // 3}-0{1 + i % 3}", v, a) for i, (v, a) in enumerate([("x", 5.0), ("y", 9.0), ("z", 9.0)] * 4)] + [(12, "2025-05-01", "x", 5.0)]
    t = spark.createDataFrame(rows, "tx_index int, d string, vendor string, a double").select(F.lit("s").alias("statement_id"), "tx_index", F.col("d").cast("date").alias("tx_date"), F.lit("d").alias("description"), "vendor", F.lit(None).cast("decimal(18,2)").alias("deposit"), F.col("a").cast("decimal(18,2)").alias("withdrawal"))
    got = [(r["place"], r["vendor_key"], r["n"]) for r in forensic.recurring_groups(t).orderBy("place").collect()]
    assert got == [(1, "x", 5), (2, "y", 4), (3, "z", 4)]


def test_context_near_the_top(spark):
    t = spark.range(30).select(F.lit("s").alias("statement_id"), F.col("id").cast("int").alias("tx_index"))
    a = spark.createDataFrame([("s", 0, 1), ("s", 1, None), ("s", 2, 20)], "statement_id string, ordinal int, transaction_index int")
    got = {}
    for r in analytics.anomaly_context(a, t, before=8, after=8, most=10).collect():
        got.setdefault(r["ordinal"], []).append(r["tx_index"])
    assert {k: sorted(v) for k, v in got.items()} == {0: list(range(10)), 1: list(range(9)), 2: list(range(12, 22))}


def _files(path):
    return sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(path))


def test_keyed_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = KeyedTable(spark, path, "key", 128)
    with pytest.raises(ValueError):
        table.read()
    rows = lambda keys, v: spark.createDataFrame([(f"k{k}", v, k) for k in keys], "key string, v string, bucket int")
    assert table.upsert(rows(range(2000), "old")) == 1
    first, before = table.read(), _files(tmp_path)
    assert table.upsert(rows(range(0, 2000, 100), "new").unionByName(rows([0], "newer")), ("v",)) == 2
    assert _files(tmp_path) - before <= 20 < before  # the buckets of twenty keys
    content = {r["key"]: r["v"] for r in KeyedTable(spark, path).read().collect()}
    assert len(content) == 2000 and content["k0"] == "newer" and content["k100"] == "new" and content["k1"] == "old"
    assert {r["v"] for r in first.collect()} == {"old"} and table.read(1).where("v = 'old'").count() == 2000  # readers keep their version

    broken = rows(range(5), "x").withColumn("v", F.when(F.col("bucket") >= 0, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.upsert(broken)
    assert table.versions() == [1, 2] and table.read().count() == 2000  # a write that dies leaves the table as it was
    with pytest.raises(RuntimeError):
        table._commit(2, {}, first.schema)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "v", 1)], "key string, v string, bucket int"))

    table.delete(rows([1, 2, 9999], ""))
    table.delete_where(F.col("bucket") >= 1000)
    assert table.read().count() == 998 and table.read().where("key in ('k1', 'k2')").count() == 0
    table.vacuum(1)
    assert table.versions() == [4] and table.read().count() == 998
    table.clear()
    assert table.read().count() == 0 and table.read().columns == ["key", "v", "bucket"]
    assert table.upsert(rows([1], "again")) == 6 and table.read().count() == 1
    assert table.upsert(rows([], "")) == 7 and table.read().count() == 1


def test_statement_cache(spark, tmp_path):
    cache = stores.StatementCache(spark, f"file://{tmp_path}/c", 64)
    row = lambda k, at, ok, p: (k, at, ok, p)
    df = lambda *rs: spark.createDataFrame(list(rs), "key string, at string, reconciled boolean, payload string").select("key", F.col("at").cast("timestamp").alias("created_at"), "reconciled", "payload")
    cache.put(df(row("a", "2025-01-01", True, "1"), row("a", "2025-01-02", True, "2"), row("b", "2025-03-01", False, "no"), row("c", None, True, "3")))
    cache.put(df(row("a", "2024-01-01", True, "replaced"), row("d", "2025-03-01", True, "4")))
    assert {r["key"]: r["payload"] for r in cache.table.read().collect()} == {"a": "replaced", "c": "3", "d": "4"}
    assert [r["payload"] for r in cache.get(df(row("a", None, None, None), row("zz", None, None, None))).collect()] == ["replaced"]
    assert [r["key"] for r in cache.keys(2).collect()] == ["d", "a"] and cache.stats().first()["total"] == 3
    cache.expire("2025-03-02")
    assert {r["key"] for r in cache.table.read().collect()} == {"c", "d"}
    cache.delete("d")
    assert {r["key"] for r in cache.table.read().collect()} == {"c"}
    cache.clear()
    assert cache.stats().first()["total"] == 0


def test_quarantine(spark, tmp_path):
    good = {"account": {"account_last4": "1", "period": {"start": "2025-04-01"}}, "transactions": [{"date": "2025-04-03", "description": "z", "deposit": 1.0}]}
    (tmp_path / "a.json").write_text(json.dumps([good, good]))
    (tmp_path / "b.json").write_text('{"account": {"account_last4": ')
    (tmp_path / "c.json").write_text(json.dumps(good | {"transactions": "none"}))
    got, broken = files.read_or_quarantine(spark, str(tmp_path))
    assert got.count() == 2 and files.explode_statements(got)["transactions"].count() == 2
    rows = {os.path.basename(r["path"]): (r["reason"], r["raw"][:9]) for r in broken.collect()}
    assert rows == {"b.json": ("not JSON", '{"account'), "c.json": ("a value of another type", '{"account')}
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        files.read_statements_json(spark, str(tmp_path)).collect()


def test_reconciliation_is_kept_up_by_deltas(spark, tmp_path):
    t = ledger.transactions(spark, SF).drop("account_last4").withColumn("sign", F.lit(1))
    s = ledger.statements(spark, ledger.transactions(spark, SF))
    wrong = t.where("tx_index = 0").withColumn("deposit", F.lit(77).cast("decimal(18,2)"))
    right = t.where("tx_index = 0")
    parts = [t.where("tx_index > 0 and tx_index % 2 = 0").unionByName(wrong), t.where("tx_index % 2 = 1"), wrong.withColumn("sign", F.lit(-1)).unionByName(right)]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
        q = events.streaming_reconcile(s, stream, f"file://{tmp_path}/out", str(tmp_path / "cp"), 16)
        q.awaitTermination()
        assert q.recentProgress[0]["numInputRows"] == p.count()  # its own rows, none of before
        rows = events.latest_reconciliation(spark, f"file://{tmp_path}/out")
        assert rows.count() == s.count() if i else rows.count() > 0
    want = checks.reconcile(s, t)
    key = lambda df: sorted(tuple(str(r[c]) for c in want.columns) for r in df.select(want.columns).collect())
    assert key(rows) == key(want)


def test_job_board(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    batches = [
        [("old", "2025-01-01 00:00:00", "queued"), ("old", "2025-01-01 00:10:00", "done"), ("stuck", "2025-01-01 00:00:00", "queued"), ("none", None, "queued")],
        [(f"j{i}", f"2025-01-01 05:{i:02d}:00", e) for i in range(6) for e in ("go", "done")] + [("open", "2025-01-01 05:00:00", "queued"), ("bad", "2025-01-01 05:30:00", "error")],
        [("tick", "2025-01-01 05:59:00", "queued")],
        [("tick", "2025-01-01 05:59:30", "go")],
    ]
    for i, rows in enumerate(batches):
        (log / f"{i}.json").write_text("\n".join(events.event_row(*r) for r in rows))
        os.utime(log / f"{i}.json", (1_700_000_000 + i,) * 2)
    q = jobs.job_board(events.event_source(spark, str(log), 1), f"file://{tmp_path}/board", str(tmp_path / "cp"), ttl_seconds=3600, timeout_seconds=3 * 3600, max_jobs=6, watermark="1 minute")
    assert q.awaitTermination(120)
    got = {r["job_id"]: (r["status"], r["n_events"]) for r in jobs.live_jobs(spark, f"file://{tmp_path}/board").collect()}
    batch = events.job_lifecycle(spark.read.schema(events.EVENT).json(str(log))).where("job_id <> 'stuck'")  # it timed out
    want = {r["job_id"]: (r["status"], r["n_events"]) for r in events.job_ttl_evict(batch, "2025-01-01 05:58:30", 3600, 6).collect()}
    assert got == want and set(got) == {"open", "tick", "bad", "j5", "j4", "j3"}


def test_changes_of_large_extractions(spark):
    t = ledger.transactions(spark, SF)
    b = t.where("o_orderkey % 700 <> 1").withColumn("category", F.when(F.col("o_orderkey") % 800 == 2, "NEW").otherwise(F.col("category")))
    key = lambda d: sorted((r["statement_id"], r["k_desc"], r["status"], str(r["fields"])) for r in d.collect())
    want = key(analytics.diff_rows(t, b).where("status <> 'common'"))
    assert key(analytics.diff_changes(t, b)) == want and len(want) > 1
    assert key(analytics.diff_changes(t, b, buckets=3)) == want and key(analytics.diff_changes(b, b)) == []
    assert len(key(analytics.diff_changes(t.limit(0), b))) == len(key(analytics.diff_rows(t.limit(0), b)))
