"""The training-data operators against brute force, and on nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import decontam, licenses, line_chunks, near_copies, packing, quality, queries, recompression, simhash, slots, token_blocks, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t ", "one", "one two", "a b c", "x" * 3000, "the of and " * 400, "é ü ñ 日本 🙂 words", "\n\n\n", "tab\tand\x0bvt\x0cff\rcr"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "en" if i is None or i % 3 else None, "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    # Extra columns whose names clash with what operators add.
    return spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit(1), "slot": F.lit(2), "kept": F.lit("x"), "place": F.lit(3), "fp": F.lit(4), "_doc": F.lit(5), "words": F.lit(6), "n_words": F.lit(7)})


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [text(rnd.randint(50, 130)) for _ in range(12)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            x = rnd.random()
            if x < 0.35:
                parts.append(rnd.choice(shared))
            elif x < 0.5:
                p = rnd.choice(shared).split()
                p[rnd.randrange(len(p))] = "changed"
                parts.append(" ".join(p))
            elif x < 0.6:
                parts.append(" ".join(["z"] * rnd.choice([49, 50, 120])))
            else:
                parts.append(text(rnd.randint(1, 150)))
        out.append("\n".join(parts))
    return out + out[:25] + EDGE


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_recompression(spark, corpus):
    first, expected = {}, []
    for i, t in enumerate(corpus):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in enumerate(corpus):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = sorted(tuple(r) for r in recompression.repeated_substrings(frame(spark, corpus)).collect())
    assert got == expected and sum(x[2] for x in got) > 1000


def test_recompression_null_and_repeated_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    d = frame(spark, [text, text, text], [None, 5, 5])
    assert sorted(((r["doc_id"] or 0), r["n_removed"]) for r in recompression.repeated_substrings(d).collect()) == [(0, 60), (5, 0), (5, 0)]


def brute_fingerprint(t):
    import xxhash

    w = [x.encode() for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_simhash(spark, corpus):
    fp = np.array([brute_fingerprint(t) for t in corpus], np.uint64)
    root = list(range(len(fp)))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, corpus)).collect()}
    assert got == {i: (f"{int(fp[i]):016x}", root[i]) for i in range(len(fp))}


def test_simhash_links_by_tiles(spark):
    rnd = np.random.default_rng(1)
    fp = rnd.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    fp[1000:2000] = fp[:1000] ^ (np.uint64(1) << rnd.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 1000).astype(np.uint64))
    fp = np.unique(fp)
    roots = simhash.components(simhash.near_links(spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "id long, fp long")))
    got = {r["fp"]: r["root"] for r in roots.collect()}
    signed = fp.view(np.int64)
    root = {int(x): int(x) for x in signed}
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3):
            a, b = root[int(signed[i])], root[int(signed[j])]
            if a != b:
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {k: root[k] for k in got} == got and all(root[k] == k for k in root if k not in got)


def _ids(texts, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


TRICKY = ["a  b  c\n\n d\t e", "İstanbul don't 'S'll 12 3", "\x01 x \x01", "é ́x", "<|endoftext|> hi<|endoftext|>", "x\n", "\n\n  y\n z ", "\U0001f600 ​ ok\xa0nbsp", "ΑΣ ΑΣΑ", "a b \x85 c\x1cd"]


def test_token_files(spark, corpus):
    import public_tokenizers

    texts = corpus + TRICKY
    expected = _ids(texts, "word_bpe_49k.json", 1)
    start = np.cumsum([0, *map(len, expected)])
    got = token_blocks.token_files(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, int(start[i]), len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(expected)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    for top in (1, 2, 300, 60_000, 2**32):
        ids = rnd.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        if n:
            ids[rnd.integers(0, n, n // 20)] = 2**32 - 1
        docs, back = token_blocks.decode_file(token_blocks.encode_file([3, -7], [n, 0], ids))
        assert np.array_equal(back, ids) and docs["id"].tolist() == [3, -7]
    with pytest.raises(ValueError):
        token_blocks.decode_file(b"X" * 100)


def test_packing(spark, corpus, monkeypatch):
    import public_tokenizers

    texts = [*corpus, *TRICKY, corpus[0] * 9]
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)  # by a shuffle join
    ids = _ids(texts, "byte_bpe_50k.json", 2)
    placement, placed = packing.pack_documents(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"))
    rows = placement.orderBy("sequence_id", "offset").collect()
    seen = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        assert r["offset"] == seen.get(r["sequence_id"], 0)
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids)) and max(seen.values()) <= 1024
    assert len(seen) <= -(-sum(map(len, ids)) // 1024) + 3
    whole = packing.packed_sequences(placed).collect()
    assert len(whole) == len(seen)
    for r in whole:
        at, flat = 0, np.frombuffer(r["ids"], "<u2")
        for doc, piece, n in zip(r["doc_ids"], r["pieces"], r["lengths"], strict=True):
            start = packing.cut(len(ids[doc]), 1024)[piece][0]
            assert flat[at : at + n].tolist() == ids[doc][start : start + n].tolist()
            at += n


def test_best_two_fit_is_near_the_bound():
    rnd = random.Random(3)
    for _ in range(20):
        counts = {rnd.randint(1, 1024): rnd.randint(1, 500) for _ in range(rnd.randint(1, 200))}
        plan = packing.best_two_fit(counts, 1024)
        used = {}
        for pattern, times in plan:
            assert sum(pattern) <= 1024 and times > 0
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == counts
        bound = max(sum(n * c for n, c in counts.items()) / 1024, sum(c for n, c in counts.items() if n > 512))
        assert sum(t for _, t in plan) <= 1.1 * bound + 2


def test_quality_keeps_every_row(spark, corpus):
    d = quality.quality_rules(frame(spark, corpus))
    assert d.count() == len(corpus) and "n_words" in d.columns and "fp" in d.columns
    failed = {r["doc_id"] for r in d.where("base_failed").select("doc_id").collect()}
    assert {i for i, t in enumerate(corpus) if len(words(t)) < 50} <= failed


def test_decontamination(spark):
    rnd = random.Random(5)
    item = [f"q{rnd.randint(0, 300)}" for _ in range(40)]
    noisy = [w if i % 9 else "other" for i, w in enumerate(item)]
    far = [w if i % 2 else "other" for i, w in enumerate(item)]
    pad = " ".join(f"p{i}" for i in range(30))
    texts = [f"{pad} {' '.join(item)} {pad}", f"{' '.join(noisy).upper()}!", " ".join(far), pad, None, "", " ".join(item[5:30])]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "short one"), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["first_item"]) for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    assert got == {0: (True, 1), 1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 1)}
    kept = decontam.decontaminated(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5] and "_bad_th" not in kept.columns


def test_licenses(spark):
    texts = ["A line.\nReleased under the MIT License.\nEnd", licenses.TEMPLATES["ISC"].upper(), None, "", "Released under the something else entirely here", "released under the mit licence now"]
    got = {r["doc_id"]: (r["license"], r["line"]) for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got[0] == ("MIT-notice", 1) and got[1] == ("ISC", 0) and all(got[i] == (None, None) for i in (2, 3, 4, 5))


def test_url_filters(spark):
    entries = spark.createDataFrame(
        [("domain", "bad.com", "2024-01-01", "block"), ("host", "ok.bad.com", "2024-01-05", "allow"), ("domain", "bad.com", "2024-02-01", "remove"), ("url", "x.org/p?q=1", "2024-01-01", "block"), ("host", None, "2024-01-01", "block"), ("host", "n.org", None, "block"), ("domain", "twice.com", "2024-01-01", "block"), ("domain", "twice.com", "2024-01-01", "remove")],
        "kind string, key string, day string, action string",
    ).withColumn("day", F.col("day").cast("date"))
    cases = [
        ("http://a.bad.com/x", "2024-01-10", "block"), ("http://ok.bad.com/x", "2024-01-10", "allow"), ("http://ok.bad.com/x", "2024-01-02", "block"), ("http://a.bad.com/x", "2023-12-31", "allow"),
        ("http://a.bad.com/x", "2024-02-01", "allow"), ("HTTPS://u@X.org.:443/p?q=1#f", "2024-01-01", "block"), ("http://x.org/p", "2024-01-01", "allow"), (None, "2024-01-01", "allow"),
        ("nonsense", "2024-01-01", "allow"), ("http://a.bad.com/", None, "allow"), ("http://twice.com", "2024-01-03", "allow"), ("http://notbad.com", "2024-01-10", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)], "page_id int, url string, day string").withColumns({"day": F.col("day").cast("date"), "host": F.lit("clash")})
    got = url_filters.judge(pages, entries).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == [v for _, _, v in cases] and got[0]["action_key"] == "bad.com"


def test_empty_tables(spark):
    import public_tokenizers

    none = frame(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for d in (
        quality.quality_rules(none), quality.passing(none), licenses.scan_licenses(none), line_chunks.remove_repeated_chunks(none), decontam.contaminated(none, bench), decontam.contaminated(frame(spark, ["a b"]), bench.limit(0)).where("contaminated"),
        recompression.repeated_substrings(none), simhash.near_duplicates(none), near_copies.one_of_each(none), token_blocks.token_files(none, word), packing.pack_documents(none, byte)[0], packing.packed_sequences(packing.pack_documents(none, byte)[1]),
    ):
        assert d.count() == 0


@pytest.mark.parametrize("name, key", [("op1_url_filters", "page_id"), ("op3_quality_rules", "doc_id"), ("op4_license_scan", "doc_id"), ("op7_spaced_seeds", "doc_id")])
def test_sql_agrees(spark, name, key):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    d = queries.queries()[name](spark, sf)
    expected = c.sql(f"select {', '.join(d.columns)} from ({queries.oracle_sql()[name]}) order by {key}").fetchall()
    assert [tuple(r) for r in d.orderBy(key).collect()] == expected


def test_native_plans(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op3_quality_rules", "op4_license_scan", "op7_spaced_seeds"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name
