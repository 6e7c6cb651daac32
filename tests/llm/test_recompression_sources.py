"""Windows whose words are all removed are still what later documents are compared with."""

from __future__ import annotations

from ledgerflow.llm import recompression


def test_covered_windows_stay_sources(spark):
    texts = []
    for group in range(60):  # four documents each, with words of their own and other parsing
        base = [f"g{group}w{k}" for k in range(200)]
        for changed in ((100,), (60,), (), (50, 110)):
            texts.append(" ".join(f"x{len(texts)}" if k in changed else w for k, w in enumerate(base)))
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(texts):
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        expected[i] = len(gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in recompression.repeated_substrings(docs).collect()}
    assert got == expected
