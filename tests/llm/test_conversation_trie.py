"""The prefix trie against brute force, whole and cut into many blocks, and on nulls, repeated turns and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerflow.llm import conversation_trie, prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string, block int, key string"


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    children, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words(k)
    sha = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], sha(k, m)) for k, m in nodes.items())


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def table(spark, convs, odd=()):
    rows = [(c, i, r or None, t or None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r[:4], 1, "x", 2, "y") for r in [*rows, *odd]], SCHEMA)


@pytest.fixture(scope="module")
def convs():
    rnd = random.Random(11)
    turn = lambda: (rnd.choice(["user", "assistant", ""]), rnd.choice(["", "a", "a b", " c\td ", "longer text here " * rnd.randint(1, 3)]))
    out = {}
    for c in range(400):
        if out and rnd.random() < 0.6:
            old = out[rnd.choice(list(out))]
            out[c] = [*old[: rnd.randint(0, len(old))], *[turn() for _ in range(rnd.randint(0, 3))]] or [turn()]
        else:
            out[c] = [turn() for _ in range(rnd.randint(1, 6))]
    common = [turn() for _ in range(3)]
    for c in range(400, 700):  # a hot conversation, and a deep one
        out[c] = [*common]
    deep = [turn() for _ in range(90)]
    for c in (701, 703, 706, 709, 1000, 1021):
        out[c] = deep[: rnd.randint(60, 90)] + ([turn()] if c % 2 else [])
    return out


@pytest.mark.parametrize("block_turns", [10**6, 150, 7])
@pytest.mark.parametrize("rebuild", [False, True])
def test_trie(spark, convs, block_turns, rebuild):
    got = conversation_trie.prefix_trie(table(spark, convs), rebuild=conversation_trie.rebuilt if rebuild else None, block_turns=block_turns)
    assert result(got) == brute(rebuilt(convs) if rebuild else convs)


def test_odd_rows(spark, tmp_path):
    convs = {20: [("u", "x y"), ("a", "z")], 21: [("u", "x y")], 5: [("u", "")], -3: [("u", "q")], 2**62: [("u", "word " * 200_000)]}
    odd = [(None, 0, "u", "nobody's"), (30, None, "u", "first"), (30, 0, "u", "twice"), (30, 0, "u", "twice")]
    full = convs | {30: [("u", "first"), ("u", "twice"), ("u", "twice")]}
    assert result(conversation_trie.prefix_trie(table(spark, convs, odd), rebuild=None)) == brute(full)
    table(spark, convs, odd).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(queries.op11_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(full))
    # a turnless conversation: three turns of an absent base take the place of its own ones
    lone = next(c for c in range(1, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    assert result(conversation_trie.prefix_trie(table(spark, {lone: [("u", "a")]}))) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert conversation_trie.prefix_trie(table(spark, {})).count() == 0


def test_many_equal_conversations_hash_in_order(spark):
    ids = [*range(-700, 700), 10**12, 5000]
    got = conversation_trie.prefix_trie(table(spark, {i: [("u", "same")] for i in ids}), rebuild=None)
    assert result(got)[-1][-1] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def test_range_minima():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        v = rnd.integers(0, 5, n)
        table, at = prefixes.RangeMin(v), np.arange(n)
        for d in range(6):
            left, right = table.left(at, np.full(n, d)), table.right(at, np.full(n, d))
            for i in range(n):
                lo = hi = i
                while lo > 0 and v[lo] >= d:
                    lo -= 1
                while hi + 1 < n and v[hi + 1] >= d:
                    hi += 1
                assert (left[i], right[i]) == (lo, hi)
        lows = rnd.integers(0, n, 50)
        highs = np.array([rnd.integers(x, n) for x in lows])
        assert table.minimum(lows, highs).tolist() == [v[a : b + 1].min() for a, b in zip(lows, highs, strict=True)]
