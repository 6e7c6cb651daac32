"""Line chunks: the rule restated by itself, shift resistance, recall on repeated runs, edge rows and clashing names."""

from __future__ import annotations

import random

from ledgerflow.llm import line_chunks

SCHEMA = "doc_id long, text string, doc string, th int, n_lines string, drop int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "theirs", 1, "x", 2) for i, t in rows], SCHEMA)


def _got(spark, rows):
    d = line_chunks.remove_repeated_chunks(_frame(spark, rows))
    assert d.columns == ["doc_id", "text", "doc", "th", "drop", "n_lines", "n_removed_lines"]
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in d.collect()}


def _corpus():
    rnd = random.Random(12)
    line = lambda: " ".join(f"w{rnd.randint(0, 10**5)}" for _ in range(rnd.randint(1, 9)))
    passages = [[line() for _ in range(rnd.randint(2, 12))] for _ in range(40)]
    out = []
    for _ in range(200):
        lines = [line() for _ in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(0, 3)):
            lines += [*rnd.choice(passages), *[rnd.choice(["", line(), "- - -"]) for _ in range(rnd.randint(0, 4))]]
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n\n", "é 日本\nü\n" * 5, "a\nb\n" * 3000], passages


def _boundaries(lines):
    """The rule by itself: a boundary follows a line where the hash of the last two lines, mixed, is 0 modulo 4 in its upper half."""
    import xxhash

    mask, k = 2**64 - 1, 0x9E3779B97F4A7C15
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    cuts = {0, len(lines)}
    for i, x in enumerate(h):
        v = x * k + (h[i - 1] * k * k if i else 0) & mask
        v = (v ^ v >> 29) * 0xD6E8FEB86659FD93 & mask
        if (v >> 32) % 4 == 0:
            cuts.add(i + 1)
    return sorted(cuts)


def brute(texts):
    """place -> (text left, lines, removed lines)"""
    split = [None if t is None else t.encode().split(b"\n") for t in texts]
    first, units = {}, {}
    for i, lines in enumerate(split):
        cuts = [] if lines is None else _boundaries(lines)
        pairs = [(a, a + 2) for a in range(len(lines or []) - 1) if lines[a].strip() or lines[a + 1].strip()]
        units[i] = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 2] + pairs
        for a, b in units[i]:
            first.setdefault(tuple(lines[a:b]), (i, a))
    expected = {}
    for i, lines in enumerate(split):
        gone = {k for a, b in units[i] if first[tuple(lines[a:b])] != (i, a) for k in range(a, b)}
        kept = texts[i] if not gone else b"\n".join(v for k, v in enumerate(lines) if k not in gone).decode()
        expected[i] = (kept, len(lines or []), len(gone))
    return expected


def test_against_the_rule_restated(spark):
    texts, _ = _corpus()
    expected = brute(texts)
    assert _got(spark, enumerate(texts)) == expected
    left = {x for t, _, _ in expected.values() for x in (t or "").split("\n")}
    assert {x for t in texts for x in (t or "").split("\n")} == left  # each content stays once


def repeated_lines(rows):
    """id -> number of lines in runs of two or more that an earlier document has; rows by rising id."""
    seen, marked = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        pairs = [p in seen for p in zip(lines, lines[1:], strict=False)]
        marked[i] = sum(any(pairs[max(k - 1, 0) : k + 1]) for k in range(len(lines)))
        seen |= set(zip(lines, lines[1:], strict=False))
    return marked


def test_all_repeated_runs_of_the_given_table_go(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in d.collect())
    marked, own = repeated_lines(rows), {i: len(t.split("\n")) - len(set(t.split("\n"))) for i, t in rows}
    got = {r["doc_id"]: r["n_removed_lines"] for r in line_chunks.remove_repeated_chunks(d).collect()}
    assert sum(marked.values()) > 100
    assert all(got[i] >= n for i, n in marked.items())
    assert all(got[i] == n for i, n in marked.items() if not own[i])  # a text may also repeat itself


def test_boundaries_move_along_with_the_text():
    rnd = random.Random(1)
    lines = [f"line {rnd.randint(0, 10**9)}".encode() for _ in range(300)]
    one = {tuple(lines[a : a + n]) for a, n in line_chunks.chunks_of(lines)}
    shifted = [b"new", *lines[:150], b"inserted", *lines[151:]]
    two = {tuple(shifted[a : a + n]) for a, n in line_chunks.chunks_of(shifted)}
    assert len(one & two) >= len(one) - 6


def test_edge_rows(spark):
    block = "\n".join(f"line {i}" for i in range(12))
    rows = [(3, block), (3, block), (7, "own\n" + block + "\nend"), (None, block), (None, None), (9, "own first\nother")]
    d = line_chunks.remove_repeated_chunks(_frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed_lines"]) for r in d) == [(0, 0), (0, 12), (3, 0), (3, 0), (7, 12), (9, 0)]
    assert line_chunks.remove_repeated_chunks(_frame(spark, rows).limit(0)).count() == 0
