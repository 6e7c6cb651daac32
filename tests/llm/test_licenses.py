"""License scans: wrapped blocks inside files, repeated rows, very long texts, clashing names and planted recall."""

from __future__ import annotations

import random
import textwrap

import duckdb

from ledgerflow.llm import licenses, queries

SCHEMA = "doc_id long, text string, license string, th int, line string, bg long"


def _scan(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "theirs", 1, "x", 2) for i, t in texts], SCHEMA)
    return licenses.scan_licenses(docs, **options).collect()


def test_repeated_rows_count_once(spark):
    texts = ["Released under the Foo License.", "Released under the MIT License.", "x\nReleased under the MIT License.\ny"]
    once = {(r["doc_id"], r["license"], r["dice"], r["n_matches"]) for r in _scan(spark, list(enumerate(texts)))}
    twice = _scan(spark, [*enumerate(texts), *enumerate(texts), (None, texts[1]), (None, texts[1])])
    assert {(r["doc_id"], r["license"], r["dice"], r["n_matches"]) for r in twice if r["doc_id"] is not None} == once and len(twice) == 8
    assert once == {(0, None, None, 0), (1, "MIT-notice", 1.0, 1), (2, "MIT-notice", 1.0, 1)}


def test_wrapped_blocks_in_files_are_found(spark):
    """Recall over all long templates, wrapped at several widths, commented, with a word changed, inside code."""
    rnd = random.Random(1)
    code = lambda: [f"value_{rnd.randint(0, 99)} = call(of, the, {rnd.randint(0, 9)})" for _ in range(rnd.randint(3, 30))]
    texts, expected = [], []
    for name, t in licenses.TEMPLATES.items():
        for width in (40, 70, 100):
            w = t.split()
            if len(w) > 30:
                w[rnd.randrange(len(w))] = "altered"
            block = [f"# {x}" for x in textwrap.wrap(" ".join(w), width)]
            if len(block) < 3:
                continue
            block.insert(len(block) // 2, "#")
            texts.append("\n".join([*code(), "", *block, "", *code()]))
            expected.append((name, block[0], len(block)))
    got = {r["doc_id"]: r for r in _scan(spark, list(enumerate(texts)))}
    found = [got[i]["license"] == e[0] and texts[i].split("\n")[got[i]["line"]] == e[1] for i, e in enumerate(expected)]
    assert len(expected) > 15 and sum(found) / len(found) >= 0.9
    clean = _scan(spark, [(i, "\n".join(code())) for i in range(50)])
    assert all(r["license"] is None for r in clean)


def test_long_texts_and_blocks_by_shuffle(spark, monkeypatch):
    long = "\n".join(["some words of the common kind and more of them"] * 3000 + textwrap.wrap(licenses.TEMPLATES["MIT"], 70) + ["the end of it"] * 3000)
    for limit in (500_000, 0):
        monkeypatch.setattr(licenses, "BROADCAST_BLOCKS", limit)
        (r,) = _scan(spark, [(1, long)])
        assert (r["license"], r["line"]) == ("MIT", 3000)
    own = _scan(spark, [(1, "a b c d e f g"), (2, None), (3, "")], templates={"own": "a b c d e f h", "empty": ""})
    assert [r["license"] for r in sorted(own, key=lambda r: r["doc_id"])] == ["own", None, None]


def test_notices_inside_longer_lines(spark):
    """Recall of all templates within a long line, with a word changed in the long ones; ordinary prose has none."""
    rnd = random.Random(2)
    vocab = "of the in this and to be a work file is use under with terms for any source code whole words some more".split()
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    texts, expected = [], []
    for name, t in licenses.TEMPLATES.items():
        for n in (10, 60, 3000):
            w = t.split()
            if len(w) > 30:
                w[rnd.randrange(len(w))] = "altered"
            texts.append(f"A first line.\n{prose(n)}. {' '.join(w)} {prose(n)}\nlast")
            expected.append(name)
    got = {r["doc_id"]: r for r in _scan(spark, [*enumerate(texts), *enumerate(texts)])}
    found = [(got[i]["license"], got[i]["line"], got[i]["n_lines"]) == (e, 1, 1) for i, e in enumerate(expected)]
    assert sum(found) / len(found) >= 0.9, [e for e, f in zip(expected, found) if not f]
    (r,) = _scan(spark, [(1, "Some words. Released under the MIT License. More words and more of them, all in one line here.")])
    assert (r["license"], r["dice"], r["line"], r["n_matches"]) == ("MIT-notice", 1.0, 0, 1)
    (r,) = _scan(spark, [(1, "Released under the MIT License. " + prose(30) + " Released under the MIT License. " + prose(30))])
    assert (r["license"], r["dice"], r["n_matches"]) == ("MIT-notice", 1.0, 2)
    assert all(r["license"] is None for r in _scan(spark, [(i, prose(400)) for i in range(40)]))


def test_sql_agrees_on_files_and_long_lines(spark, tmp_path):
    rnd = random.Random(3)
    texts = []
    for t in licenses.TEMPLATES.values():
        w = t.split()
        changed = [x for x in w if rnd.random() > 0.05]
        texts += [f"so it is: {' '.join(w)} and so on " * n for n in (1, 2)]
        texts += [f"some words {' '.join(changed)} of the kind\n" + "\n".join(textwrap.wrap(t, 50)), "x\n" + " ".join(w[:7] + ["of", "the"] * 9 + w[7:])]
    texts += ["", "MIT", "Released under the MIT\nLicense"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_license_scan(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.oracle_sql()["op4_license_scan"]).fetchall())
    assert sum(r["license"] is not None for r in got) > 30
