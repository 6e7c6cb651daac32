"""The ledger view over the star-schema tables: orders are transactions, 60 customers in a row are an account, its years statements.

So statements grow in number with the tables, not in length. The same SQL runs on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TX = """
SELECT concat(account_last4, '-', cast(year(o_orderdate) AS STRING)) AS statement_id, account_last4,
       cast(row_number() OVER (PARTITION BY account_last4, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS tx_index,
       cast(o_orderdate AS DATE) AS tx_date,
       concat('ORDER ', cast(o_orderkey AS STRING), ' ', o_orderpriority) AS description,
       CASE WHEN o_orderstatus =  'F' THEN cast(o_totalprice AS DECIMAL(18,2)) END AS deposit,
       CASE WHEN o_orderstatus <> 'F' THEN cast(o_totalprice AS DECIMAL(18,2)) END AS withdrawal,
       c_mktsegment AS vendor, o_orderpriority AS category,
       cast(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, o_orderkey
FROM (SELECT *, lpad(k, cast(greatest(4, length(k)) AS INT), '0') AS account_last4
      FROM (SELECT *, cast(cast(floor(o_custkey / 60) AS BIGINT) AS STRING) AS k FROM {orders} JOIN {customer} ON o_custkey = c_custkey) o) a"""

# Planted: deposits 10.00 too high for accounts divisible by 5, a withdrawal too many for 7, no counts for 11, a balance break of
# 25.00 where account and year sum to a multiple of 6.
STATEMENTS = """
SELECT statement_id, k * 10000 + y AS doc_pos, account_last4,
       make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end,
       cast(b AS DECIMAL(18,2)) AS beginning_balance, cast(b + dep - wd AS DECIMAL(18,2)) AS ending_balance,
       cast(dep + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS deposits_total, cast(wd AS DECIMAL(18,2)) AS withdrawals_total,
       cast(CASE WHEN k % 11 <> 0 THEN nd END AS INT) AS deposits_count,
       cast(CASE WHEN k % 11 <> 0 THEN nw + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS INT) AS withdrawals_count,
       cast(CASE WHEN k % 3 > 0 THEN 'USD' END AS STRING) AS currency
FROM (SELECT *, 1000 + coalesce(sum(dep - wd) OVER (PARTITION BY account_last4 ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + sum(CASE WHEN (k + y) % 6 = 0 AND y > y0 THEN 25 ELSE 0 END) OVER (PARTITION BY account_last4 ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b
      FROM (SELECT statement_id, account_last4, cast(account_last4 AS BIGINT) AS k, year(min(tx_date)) AS y, min(year(min(tx_date))) OVER (PARTITION BY account_last4) AS y0,
                   cast(coalesce(sum(deposit), 0) AS DECIMAL(20,2)) AS dep, cast(coalesce(sum(withdrawal), 0) AS DECIMAL(20,2)) AS wd,
                   count(deposit) AS nd, count(withdrawal) AS nw
            FROM {tx} GROUP BY statement_id, account_last4) g) h"""

#: Extraction B: rows left out, categories changed, copies a day later.
TX_B = """
SELECT statement_id, account_last4, tx_index, tx_date, description, deposit, withdrawal, vendor,
       CASE WHEN o_orderkey % 13 = 0 THEN 'CHANGED' ELSE category END AS category, confidence, o_orderkey FROM {tx} WHERE o_orderkey % 17 <> 0
UNION ALL
SELECT statement_id, account_last4, tx_index + 100000, cast(tx_date + INTERVAL 1 DAY AS DATE), description, deposit, withdrawal, vendor, category, confidence, o_orderkey
FROM {tx} WHERE o_orderkey % 19 = 0"""

CALLS = """
SELECT event_id AS call_id, cast(ts AS TIMESTAMP) AS ts, concat('u', cast(user_id % 8 AS STRING)) AS budget, event_type AS backend, cast(user_id % 4 AS STRING) AS role,
       concat('m', cast(user_id % 3 AS STRING)) AS model, user_id % 1000 AS input_tokens, event_id % 500 AS output_tokens,
       user_id % 7 AS cache_read_tokens, event_id % 11 AS cache_write_tokens,
       cast(value AS DOUBLE) AS elapsed_s, cast(round(value, 2) AS DECIMAL(18,2)) AS cost_usd, CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error FROM {events}"""

JOB_EVENTS = """
SELECT cast(user_id AS STRING) AS job_id, cast(ts AS TIMESTAMP) AS ts, CASE WHEN event_type = 'purchase' THEN 'done' ELSE event_type END AS event, props AS data FROM {events}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TX, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def statements(spark: SparkSession, tx: DataFrame) -> DataFrame:
    return spark.sql(STATEMENTS, tx=tx)


def extraction_b(spark: SparkSession, tx: DataFrame) -> DataFrame:
    return spark.sql(TX_B, tx=tx)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CALLS, events=table(spark, sf_dir, "events"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOB_EVENTS, events=table(spark, sf_dir, "events"))


def duckdb_with() -> str:
    """The views as common table expressions for DuckDB."""
    tx = TX.format(orders="orders", customer="customer")
    parts = {"tx": tx, "stmt": STATEMENTS.format(tx="tx"), "txb": TX_B.format(tx="tx"), "calls": CALLS.format(events="events"), "jobev": JOB_EVENTS.format(events="events")}
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items())
