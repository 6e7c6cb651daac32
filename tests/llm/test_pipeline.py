from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import test_decontam
import test_line_chunks
import test_quality
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerflow.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, before, SF))
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    quality, lines, near, clean = sizes[1:]
    assert sizes[0] > quality == lines > near >= clean
    assert docs.select("doc_id").distinct().count() == clean
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {d for r in packed for d in r["doc_ids"]} == ids
    assert all(r["n_tokens"] == sum(r["lengths"]) <= corpus_pipeline.CAPACITY for r in packed)


def test_good_documents_pass_the_quality_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    some = docs.join(good, "doc_id").where("n_chars > 600").select(*docs.columns)
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert some.join(kept, "doc_id", "left_anti").count() == 0


def _fixture():
    rnd = random.Random(21)
    common = ["the", "of", "and", "a", "in", "to"]
    line = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice("stone river walks under green hill slowly bright".split()) + str(rnd.randint(0, 400)) * (rnd.random() < 0.6) for _ in range(rnd.randint(6, 14)))
    passages = [[line() for _ in range(rnd.randint(2, 6))] for _ in range(6)]
    bench = [(k, " ".join(line().split() + line().split())) for k in range(5)] + [(9, None)]
    texts = []
    for _ in range(90):
        lines = [line() for _ in range(rnd.randint(3, 12))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(lines))
            lines[at:at] = rnd.choice(passages)
        if rnd.random() < 0.15:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(bench[:5])[1])
        texts.append("\n".join(lines))
    for _ in range(15):  # near copies: a word of each line or of one line changed
        lines = rnd.choice(texts[:90]).split("\n")
        texts.append("\n".join(x + " more" if rnd.random() < 0.3 else x for x in lines))
    texts += [None, "", " \n", "short text", texts[0], "word " * 90, " ".join(f"q{rnd.randint(0, 10**6)}" for _ in range(120)), " ".join(line() for _ in range(400))]
    return texts, bench


def test_run_against_brute_force(spark, tmp_path):
    """All stages one after the other, over columns named like the operators' own."""
    texts, bench = _fixture()
    langs = [None if i % 11 == 0 else "en" for i in range(len(texts))]
    rows = [(i, t, g, "s", None if t is None else len(t), "mine", "mine", "mine", 1, 2, 3, 4) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, ref_lang string, doc string, th int, n_lines int, shift int, ids int"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = [x[0] for x in test_quality.brute(texts, langs) if x[7]]
    left = {ids[k]: v[0] for k, v in test_line_chunks.brute([texts[i] for i in ids]).items()}
    after_lines = dict(left)
    near = test_simhash.near_of([left[i] for i in ids])
    tops = set(test_simhash.linked(len(ids), near))
    left = {ids[k]: left[ids[k]] for k in sorted(tops)}
    found = test_decontam.brute(list(left.values()), bench)
    clean = {i: t for (i, t), f in zip(left.items(), found, strict=True) if not f[0]}
    assert len(texts) > len(ids) > len(left) > len(clean) > 30 and any(after_lines[i] != texts[i] for i in ids)
    before = docs
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], ({i: texts[i] for i in ids}, after_lines, left, clean), strict=False):
        before = stored(stage(spark, before, str(tmp_path)))
        assert before.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in before.collect()} == expected
        assert {(r["kept"], r["doc"], r["th"], r["n_lines"], r["ids"]) for r in before.collect()} == {("mine", "mine", 1, 2, 4)}
        assert all(r["n_chars"] == len(r["text"]) for r in before.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in clean.items()}
    got, sequences = {}, corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in sequences:
        flat, at = np.frombuffer(r["ids"], "<u2"), 0
        assert r["n_tokens"] == len(flat) <= 1024
        for doc, piece, n in zip(r["doc_ids"], r["pieces"], r["lengths"], strict=True):
            got.setdefault(doc, {})[piece] = flat[at : at + n].tolist()
            at += n
    assert {i: [x for k in sorted(p) for x in p[k]] for i, p in got.items()} == want
    assert len(sequences) <= 1.05 * sum(map(len, want.values())) / 1024 + 1


def test_stages_on_empty_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(["the", "of", "river"] * 3 + ["and"] + [f"stone{i}" for i in range(90)])
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (None, long, None, "s", 1), (2, long, "en", "s", 1), (2, long, "en", "s", 1)], schema)
    for docs, counts in ((odd.limit(0), (0, 0, 0, 0, 0)), (odd, (3, 5, 2, 5, 1))):
        for (name, stage), n in zip(corpus_pipeline.STAGES, counts, strict=True):
            got = stage(spark, docs, str(tmp_path)).collect()
            assert len(got) == n, (name, len(got))
