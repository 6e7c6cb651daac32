"""Substring dedup compares words: where many different words have one name, nothing goes that is not the same."""

from __future__ import annotations

import random

from ledgerflow.llm import recompression


def test_forced_name_collisions(spark):
    rnd = random.Random(8)
    rows, clean, copies = [], [], []
    for k in range(60):
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([60, 90, 260]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(3):  # every window holds a changed word
            x = list(w)
            for at in range(rnd.randint(10, 30), len(x), 30):
                x[at] = f"v{rnd.randint(0, 10**6)}"
            clean.append(len(rows))
            rows.append((len(rows), " ".join(x)))
        if k % 4 == 0:
            copies.append(len(rows))
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (64, 2):
        got = {r["doc_id"]: r["n_removed"] for r in recompression.repeated_substrings(docs, name_bits=bits).collect()}
        assert all(got[i] == 0 for i in clean)
        assert bits < 64 or all(got[i] == len(rows[i][1].split()) for i in copies)
        if bits < 64:  # there were candidates that only the words tell apart
            seen = recompression._found(docs.selectExpr("doc_id AS doc", "doc_id AS th", "text"), bits).where("kind = 0")
            names = seen.groupBy("name", "name2").count().where("count > 1").count()
            assert names > 0


def test_edge_rows(spark):
    text = " ".join(f"v{i}" for i in range(70))
    rows = [(None, text, 1), (None, None, 1), (4, "", 1), (5, text, 1), (5, text, 1), (5, "x " + text, 1), (9, text + " tail", 1), (11, " ".join(["z"] * 3000), 1), (12, " ".join(["z"] * 50), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in recompression.repeated_substrings(docs).collect())
    assert got == [(-1, 0, 0), (-1, 70, 70), (4, 0, 0), (5, 70, 0), (5, 70, 0), (5, 71, 0), (9, 71, 70), (11, 3000, 0), (12, 50, 50)]
    assert recompression.repeated_substrings(docs.limit(0)).count() == 0
