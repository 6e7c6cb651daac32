"""Virtual slots against brute force, block reading by the index, URL lists from files; empty, null and repeated rows, clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerflow.llm import queries, slots, token_blocks, url_filters


def _write(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_virtual_slots_query(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", "é日本", "same text"] + [" ".join("w" * rnd.randint(1, 8) for _ in range(rnd.randint(1, 60))) for _ in range(3000)] + ["copied " * 20] * 600
    rows = [(i, t, 1, "x", 5) for i, t in enumerate(texts)]
    rows += [(7, texts[7], 1, "x", 5), (7, texts[7], 1, "x", 5), (7, "other text", 1, "x", 5), (None, "no id", 1, "x", 5), (None, "no id", 1, "x", 5)]
    sf = _write(spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string, first int"), tmp_path)
    got = queries.op6_virtual_slots(spark, sf).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards, sizes, by_slot = {}, {}, {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        shards.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        assert by_slot.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]  # a slot is of one shard
    assert len(shards) == 24 and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * max(sizes.values())
    ids = {}
    for r in got:
        ids.setdefault(r["doc_id"], set()).add(r["virtual_slot"])
    assert all(len(x) == 1 for i, x in ids.items() if i is not None)


def test_slot_maps_and_extra_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}", "mine", 3, 4) for i in range(200)], "doc_id long, text string, part string, first int, shard int")
    folder, maps = slots.shard_documents(docs)
    d = slots.read_shards(spark, folder, docs)
    assert d.columns == ["doc_id", "text", "part", "first", "virtual_slot", "slot", "shard"] and {(r["part"], r["first"]) for r in d.collect()} == {("mine", 3)}
    one, two = (slots.read_map(spark, maps, v) for v in (1, 2))
    assert one.count() == two.count() == slots.SLOTS
    per_slot = d.groupBy("virtual_slot", "shard").agg(F.count("*").alias("n"))
    assert per_slot.join(two, ["virtual_slot", "shard"]).where("n = rows").count() == per_slot.count()
    sizes = {i: random.Random(i).randint(1, 1000) for i in range(slots.SLOTS)}
    even = slots.first_map()
    for shards in (24, 25):
        moved = slots.rebalanced(even, sizes, shards)
        load = [sum(sizes[s] for s in moved if moved[s] == k) for k in range(shards)]
        assert max(load) - min(load) <= 20


def test_empty_documents(spark, tmp_path):
    sf = _write(spark.createDataFrame([], "doc_id long, text string, lang string"), tmp_path)
    for name in ("op2_token_blocks", "op6_virtual_slots", "op8_best_two_fit"):
        assert queries.queries()[name](spark, sf).count() == 0


def test_token_files_with_null_and_repeated_ids_and_seeking(spark, tmp_path):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["stone", "river", "zqx", "the", "unbelievable"]) for _ in range(rnd.randint(0, 700))) for _ in range(30)]
    ids = [None, None, -(2**63), 2**63 - 1, 5, 5, *range(10, 34)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)] + [(5, texts[4], 0)], "doc_id long, text string, start int")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [tuple(r) for r in token_blocks.token_files(docs, path, folder=f"file://{tmp_path}/out").collect()]
    t = Tokenizer.from_file(path)
    encoded = {x: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in texts}
    want = sorted([(i, x) for i, x in zip(ids, texts, strict=True)] + [(5, texts[4])], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, expected = 0, []
    for i, x in want:
        expected.append((i, start, len(encoded[x]), zlib.crc32(encoded[x].tobytes())))
        start += len(encoded[x])
    assert sorted(got, key=lambda r: r[1]) == expected
    for f in tmp_path.joinpath("out").glob("*.pfor"):
        _, whole = token_blocks.decode_file(f.read_bytes())
        for a, n in [(0, 1), (511, 2), (0, len(whole)), (len(whole) - 1, 5), (len(whole), 3), (100, 700)]:
            assert np.array_equal(token_blocks.read_ids(f"file://{f}", a, n), whole[a : a + n])


def test_url_lists(spark, tmp_path):
    (tmp_path / "list.csv").write_text("kind,key,day,action\ndomain,bad.com,2024-01-01,block\nhost,ok.bad.com,2024-02-01,allow\nhost,x.org,notaday,block\n")
    entries = url_filters.read_list(spark, str(tmp_path / "list.csv"))
    long = "http://bad.com/" + "p" * 50_000
    rows = [("http://a.bad.com/1", "2024-01-05"), ("http://a.bad.com/1", "2024-01-05"), (long, "2024-01-05"), ("http://ok.bad.com/", "2024-03-01"), ("http://x.org/", "2024-03-01"), ("http://a.b.c.d.com/", None)]
    pages = spark.createDataFrame([(u, d, "mine", 1) for u, d in rows], "url string, day string, url_key string, c0 int").withColumn("day", F.col("day").cast("date"))
    got = url_filters.judge(pages, entries)
    assert got.columns[:4] == ["url", "day", "url_key", "c0"] and {r["url_key"] for r in got.collect()} == {"mine"}
    assert sorted((r["url"][:20], r["verdict"]) for r in got.collect()) == sorted((u[:20], "block" if i < 3 else "allow") for i, (u, _) in enumerate(rows))
    assert url_filters.judge(pages.limit(0), entries).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, entries.limit(0)).collect()} == {"allow"}
