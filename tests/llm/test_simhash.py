"""SimHash: small blocks and tiles give the same links, near copies against brute force and against Jaccard, edge rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerflow.llm import near_copies, simhash


def linked(n, near):
    root = list(range(n))
    for i in range(n):
        for j in near(i):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("parts, block, visitors", [(1, 40, 100), (2, 50, 200), (4, 16, 64), (8, 10_000, 10_000), (None, 65_536, 262_144)])
def test_links_do_not_depend_on_tiles(spark, monkeypatch, parts, block, visitors):
    rnd = np.random.default_rng(1)
    fp = rnd.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64)
    for k in range(300, 900):  # chains of near fingerprints, and one large group
        fp[k] = fp[k - 300 if k < 600 else 0] ^ (np.uint64(1) << np.uint64(rnd.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rnd.integers(0, 64)))
    fp = np.unique(fp)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "VISITORS", visitors)
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp.view(np.int64))], "id long, fp long")
    got = {r["fp"]: r["root"] for r in simhash.components(simhash.near_links(nodes, 3, parts)).collect()}
    root = linked(len(fp), lambda i: np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3).tolist())
    assert [got.get(i, i) for i in range(len(fp))] == root


def _shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def near_of(texts):
    """Brute force: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; all without words are alike."""
    sets = [_shingles(t) for t in texts]
    return lambda i: [j for j, b in enumerate(sets) if not (sets[i] or b) or 5 * len(sets[i] & b) >= 4 * len(sets[i] | b)]


def test_near_copies(spark):
    rnd = random.Random(3)
    text = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base = text(rnd.randint(60, 400))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(1, 3)):
            w = list(base)
            for j in rnd.sample(range(len(w)), max(1, int(len(w) * rnd.choice([0.01, 0.02, 0.03, 0.05, 0.1])))):
                w[j] = "new"
            texts.append(" ".join(w))
        texts.append(" ".join(text(rnd.randint(60, 400))))
    texts += [texts[0], texts[0].upper(), None, "", " \n", "one two", "one two", "three"]
    root = linked(len(texts), near_of(texts))
    assert 60 < len(set(root)) < len(texts) - 40
    rows = [(i, t, "theirs", 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, th int, band int, c0 int")
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.where(f"doc_id in ({','.join(map(str, sorted(set(root))))})").collect())


def test_ids_that_are_null_or_shared(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(5, a), (5, b), (5, a), (None, a), (None, "c d e f g h"), (None, "c d e f g h"), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    kept = [tuple(r) for r in near_copies.one_of_each(docs).collect()]
    assert len(kept) == 3 and set(kept) == {(5, a), (5, b), (None, "c d e f g h")}
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block, chars", [(2048, 32_000_000), (7, 3000)])
def test_chains_and_hot_groups(spark, monkeypatch, block, chars):
    """A chain whose ends are no copies, a group of hundreds, and texts that share half with many: exactly the links of brute force."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "PART_CHARS", chars)
    rnd = random.Random(9)
    words = lambda n: [f"v{rnd.randint(0, 10**6)}" for _ in range(n)]
    base, half, texts = words(200), words(100), []
    for k in range(25):  # each step changes a run of words, so the first and the last share little
        base[8 * k : 8 * k + 8] = words(8)
        texts.append(" ".join(base))
    hot = words(150)
    texts += [" ".join([*hot[:k], "odd", *hot[k:]]) for k in range(150)] + [" ".join([*half, *words(rnd.randint(10, 40))]) for _ in range(60)]
    rnd.shuffle(texts)
    want = set(linked(len(texts), near_of(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == want
    assert 2 < len(want) < 80


def test_buckets_of_fingerprints(spark, monkeypatch):
    """Small buckets, and large ones in blocks, where a group of near copies does not meet itself again: the links of brute force."""
    monkeypatch.setattr(near_copies, "BUCKET", 40)
    monkeypatch.setattr(near_copies, "LARGE", 60)
    test_chains_and_hot_groups(spark, monkeypatch, 7, 3000)
    hot = " ".join(f"h{k}" for k in range(400)).split()
    texts = [" ".join([*hot[:k], "odd", *hot[k:]]) for k in range(0, 400, 2)] + [" ".join(f"t{i}x{k}" for k in range(50 + i % 9)) for i in range(300)]
    texts += [" ".join([*t.split(), "last"]) for t in texts[200::3]]
    want = set(linked(len(texts), near_of(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == want
    assert len(want) == 301


@pytest.mark.parametrize("bucket, large", [(8192, 32768), (1000, 1050)])
def test_pairs_at_the_limit(spark, monkeypatch, bucket, large):
    """Pairs at 0.8 exactly, of which 24 bands of 6 min-hashes miss a few."""
    monkeypatch.setattr(near_copies, "BUCKET", bucket, raising=False)
    monkeypatch.setattr(near_copies, "LARGE", large, raising=False)
    base = lambda i: " ".join(f"w{i}x{k}" for k in range(44))
    texts = [t for i in range(5000) for t in (base(i), base(i) + " " + " ".join(f"n{i}x{k}" for k in range(10)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.one_of_each(docs).orderBy("doc_id").collect()] == list(range(0, len(texts), 2))


def test_given_documents_lose_copies_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.collect()]
    near = near_of([r["text"] for r in rows])
    root = linked(len(rows), near)
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == {min(rows[i]["doc_id"] for i, x in enumerate(root) if x == k) for k in set(root)}
