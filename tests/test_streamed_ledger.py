from __future__ import annotations

from ledgerflow.plans import queries
from ledgerflow.streaming import events


def test_batches_read_stored_statements(spark, monkeypatch):
    """A batch reads the statements that were stored, it does not make the ledger view anew from orders and customers."""
    seen, real = [], events.streaming_reconcile
    monkeypatch.setattr(queries.streaming, "streaming_reconcile", lambda s, *a, **k: (seen.append(s.inputFiles()), real(s, *a, **k))[1])
    assert queries.QUERIES["streaming_reconcile"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen[0] and not [f for f in seen[0] if "orders.parquet" in f or "customer.parquet" in f]
