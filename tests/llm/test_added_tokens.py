"""Queries and pipeline give texts the ids of the tokenizers library as it is, added tokens included."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerflow.llm import queries

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n<|startoftext|> z", "<|ENDOFTEXT|> A", "plain words", "", "< |endoftext|> <|end oftext|>", "a  <|endoftext|>\n\n b"]


def _ids(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4") for x in TEXTS]


def test_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    word, byte = _ids("word_bpe_49k.json", 1), _ids("byte_bpe_50k.json", 2)
    start = np.cumsum([0, *map(len, word)])
    got = queries.op2_token_blocks(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, int(start[i]), len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(word)]
    got = queries.op8_best_two_fit(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["length"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in byte]
    for r in corpus_pipeline.packing_stage(spark, docs, "").collect():
        flat, at = np.frombuffer(r["ids"], "<u2"), 0
        for doc, n in zip(r["doc_ids"], r["lengths"], strict=True):
            assert flat[at : at + n].tolist() == byte[doc].tolist()
            at += n
