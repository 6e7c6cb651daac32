"""Decontamination: the masks meet every accepted overlap; short items, repeated rows, very long texts and clashing names."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest

from ledgerflow.llm import decontam


@pytest.mark.parametrize("n", [11, 12, 13, 14, 15])
def test_every_accepted_pattern_is_met(n):
    fits = [{o + j for j in at} for at in decontam._LOOKED_AT for o in range(n - at[-1])]
    missing = n - math.ceil(decontam.MIN_AGREE * n)
    assert all(any(not set(changed) & f for f in fits) for changed in combinations(range(n), missing))


def brute(texts, items):
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    out = []
    for t in texts:
        d, found = words(t), set()
        for k, item in items:
            w = words(item)
            if len(w) < decontam.MIN_ITEM:
                if w and any(words(line) == w for line in (t or "").split("\n")):
                    found.add(k)
                continue
            v = min(len(w), decontam.STRETCH)
            need = v if len(w) <= decontam.SHORT else math.ceil(decontam.MIN_AGREE * v)
            for shift in range(-len(w), len(d) + 1):
                e = [0 <= shift + j < len(d) and d[shift + j] == x for j, x in enumerate(w)]
                if any(sum(e[s : s + v]) >= need for s in range(len(e) - v + 1)):
                    found.add(k)
                    break
        out.append((bool(found), len(found), min(found, default=None)))
    return out


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: rnd.choice([f"k{rnd.randint(0, 60)}", "the", "of", "und"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 7, 10, 11, 12, 14, 15, 16, 40, 9, 11])] + [(90, None), (91, "")]
    texts = [None, "", "the", " ".join(word() for _ in range(3000))]
    for _ in range(150):
        w = rnd.choice(items[:12])[1].split()
        for j in rnd.sample(range(len(w)), rnd.randint(0, min(4, len(w) - 1))):
            w[j] = "zz"
        texts.append(" ".join([word() for _ in range(rnd.randint(0, 9))] + w + [word() for _ in range(rnd.randint(0, 9))]).upper())
    texts += [f"more\n - {items[0][1]}!\nwords", f"more {items[0][1]}\nwords", items[0][1].upper()]
    schema = "doc_id long, text string, shift int, dw string, th long, iw int"
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)], schema)
    bench = spark.createDataFrame([*items, items[5]], "item_id long, text string")
    expected = brute(texts, items)
    assert 20 < sum(x[0] for x in expected) < len(texts)
    for limit in (1_000_000, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(decontam, "BROADCAST_HITS", limit)
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
        twice = docs.unionByName(docs.where("doc_id % 5 = 0"))
        got = decontam.contaminated(twice, bench).orderBy("doc_id").collect()
        assert {r["doc_id"]: (r["contaminated"], r["n_items"], r["first_item"]) for r in got} == dict(enumerate(expected)) and len(got) == twice.count()
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in enumerate(expected) if not x[0]]
