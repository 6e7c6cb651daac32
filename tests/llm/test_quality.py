"""Quality rules against brute force, in ANSI mode and without it, and under filters."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, kept string, ref_lang string, n_chars long, c0 int"


def _texts():
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", "river", "stone", "walks", "under", "a", "green", "hill,", "Old", "1999", "#tag"]) for _ in range(n))
    out = [prose(rnd.randint(1, 260)) for _ in range(60)]
    out += [" ".join(f"zq{rnd.randint(0, 10**6)}" for _ in range(200)) for _ in range(8)]  # no common word
    out += ["%%% ### " * 60, "a b", "", None, " \n\t", "same line here\n" * 30, "x " * 200, "one two three one two three", "é ü 日本 🙂 " * 40, "\n".join(["a b c", "d", "a b c", " ", " "])]
    return out


def _js(a, b):
    A, B = sum(a), sum(b)
    if not A or not B:
        return None
    s = 0.0
    for x, y in zip(a, b, strict=True):
        p, q = x / A, y / B
        s += ((p * math.log2(2 * p / (p + q)) if p else 0) + (q * math.log2(2 * q / (p + q)) if q else 0)) / 2
    return math.sqrt(max(s, 0))


def _counts(t):
    t = t or ""
    words = WORD.findall(t)
    rest, chars = t, []
    for _, pattern in quality.CLASSES:
        less = re.sub(pattern, "", rest)
        chars.append(len(rest) - len(less))
        rest = less
    chars.append(len(rest))
    common = [words.count(w) for w in quality.COMMON_WORDS]
    common.append(len(words) - sum(common))
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return words, chars, common, len(again), len(lines) - len(set(lines)), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t)


def brute(texts, langs):
    """(place, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each text."""
    counts = [_counts(t) for t in texts]
    refs = {}
    for lang, t, c in zip(langs, texts, counts, strict=True):
        r = refs.setdefault(lang, ([0] * len(c[1]), [0] * len(c[2])))
        if len(t or "") >= quality.MIN_CHARS_FOR_CLASSES:
            r[0][:] = [x + y for x, y in zip(r[0], c[1], strict=True)]
        if len(c[0]) >= quality.MIN_WORDS_FOR_COMMON:
            r[1][:] = [x + y for x, y in zip(r[1], c[2], strict=True)]
    expected = []
    for i, (lang, t, (words, chars, common, again, dup, word_chars, symbols)) in enumerate(zip(langs, texts, counts, strict=True)):
        failed = len(words) < 50 or 100 * again > 50 * len(words)
        dc = _js(chars, refs[lang][0]) if len(t or "") >= quality.MIN_CHARS_FOR_CLASSES else None
        dw = _js(common, refs[lang][1]) if len(words) >= quality.MIN_WORDS_FOR_COMMON else None
        far = _js([0] * len(quality.COMMON_WORDS) + [1], refs[lang][1])
        bad = dc is not None and dc > quality.MAX_CLASS_DISTANCE or dw is not None and dw > quality.MAX_WORD_SHARE * far
        expected.append((i, len(words), word_chars, symbols, dup, again, failed, not failed and not bad))
    return expected


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_against_brute_force(spark, ansi):
    texts = _texts()
    langs = [None if i % 7 == 0 else "en" if i % 2 else "de" for i in range(len(texts))]
    expected = brute(texts, langs)
    rows = [(i, t, g, "theirs", "theirs", 0, 7) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        d = quality.quality_rules(docs)
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        assert [tuple(r) for r in d.select(*names).orderBy("doc_id").collect()] == expected
        assert {r["doc_id"] for r in d.where("base_failed and n_words > 0").select("doc_id").collect()} == {x[0] for x in expected if x[6] and x[1]}
        kept = quality.passing(docs)
        assert kept.columns == docs.columns
        assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[x[0]] for x in expected if x[7])
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert any(x[7] for x in expected) and any(not x[6] and not x[7] for x in expected)


def test_given_references_and_long_texts_under_a_filter(spark):
    good = " ".join(["the", "river", "and", "a", "stone"] * 40)
    refs = quality.language_references(spark.createDataFrame([(1, good, "en")], "doc_id int, text string, lang string"))
    rnd = random.Random(4)
    long = " ".join(rnd.choice(["the", "and", "a"]) if i % 5 == 0 else f"w{rnd.randint(0, 10**6)}" for i in range(10_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, long, "xx"), (1, long, "en"), (None, None, None)], "doc_id int, text string, lang string")
    d = quality.quality_rules(docs, references=refs)
    assert d.where("not base_failed and n_repeat_words < n_words").count() == 3
    assert [r["doc_id"] for r in d.where("js_common is null and not base_failed").collect()] == [2]  # no reference, no verdict by it
    assert quality.passing(docs.limit(0), references=refs).count() == 0
    assert [r["doc_id"] for r in d.where(F.col("kept")).collect()] == [2]  # mostly digits: far from the English reference's classes
