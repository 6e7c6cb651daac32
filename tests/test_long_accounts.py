from __future__ import annotations

import duckdb
import pytest

from ledgerflow.plans import queries


@pytest.mark.parametrize("name", ["bulk_extract", "extract_summary", "segment_statements"])
def test_accounts_of_five_digits(spark, tmp_path, name):
    """Customers from 600,000 on have accounts of five digits; a text gives the last four of them, in the query and in its SQL."""
    db = duckdb.connect()
    for table, keys in (("customer", ("c_custkey",)), ("orders", ("o_custkey", "o_orderkey"))):
        moved = ", ".join(f"{k} + 600000 AS {k}" for k in keys)
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'"
        db.sql(f"COPY ({rows} UNION ALL SELECT * REPLACE ({moved}) FROM ({rows})) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path))
    expected = db.sql(queries.SQL[name])
    assert found.columns == expected.columns
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(expected.fetchall(), key=str) and len(got) > 6
