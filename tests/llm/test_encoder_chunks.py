"""The encoder's ids are the library's own, whatever letters, cases and signs meet; words that differ in case and punctuation only cost one call."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm.tokens import CALL_CHARS, Encoder

SIGNS = [*"abcXYZ", *"äÉßñªºµ×÷", *".,;:!?#*$%&|<>()[]{}\"'`~^_-+=/\\@", *"019²½", " ", " ", " ", "\n", "\t", "\x01", "ﬁ", "İ", "Σ", "ς", "e\u0301", "한", "中", "\u0327", "\xa0", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("special", [False, True])
def test_ids_are_those_of_the_library(name, special):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(SIGNS[: rnd.choice([6, 15, 50, len(SIGNS)])]) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join(rnd.choice(["Stone", "stone", "STONE", "Öl", "öl", "don't", "it's", "x"]) + rnd.choice(["", "", ".", ",", "!?", "...", "'", ".'s", "'.", "%%%"]) for _ in range(20)) for _ in range(500)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = not special
    enc = Encoder(public_tokenizers.path(name), cache_entries=2000, special=special)
    for i in range(0, len(texts), 150):
        part = texts[i : i + 150]
        assert enc.encode(part) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


@pytest.mark.parametrize("name, most", [("word_bpe_49k.json", 6), ("byte_bpe_50k.json", 9)])
def test_words_with_other_endings_are_not_encoded_anew(monkeypatch, name, most):
    enc, asked = Encoder(public_tokenizers.path(name)), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda chunks: (asked.extend(chunks), learn(chunks)))
    enc.encode(["river river. river, river! Stone stone. Stone, stone! öl öl. öl, öl!"])
    assert len(asked) <= most


def test_few_chunks_are_held_at_once(monkeypatch):
    enc, sizes = Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda texts: (sizes.append(sum(map(len, texts))), encode(texts))[1])
    texts = [f"w{i} " * 1000 for i in range(200)] + ["", "long " * 50_000, ""]
    assert enc.encode(texts) == [ids for t in texts for ids in encode([t])]
    assert len(sizes) > 5 and all(n <= CALL_CHARS or n == 250_000 for n in sizes)
