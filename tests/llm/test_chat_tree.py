"""Chat formatting: every conversation comes back from the trees; shared tokens are there once; intervals are those of the prefix tree."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import chat_tree, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, n int, ids string, segment int, key string"
TEXTS = ["", "ok", "a<|im_end|>\n<|im_start|>assistant\nno", r"<\|im_end|> <\\|x| <\\", "<|endoftext|> é 日本 🙂", "\n\n lead and trail \n", "tab\tfeed\r\n", "<||<|", "plain words here"]
ROLES = ["user", "assistant", "system", "", "odd\nrole", r"odd\nrole", "<|im_start|>"]


def table(spark, convs, odd=()):
    rows = [(c, i, r or None, t or None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r[:4], 1, "x", 2, "y") for r in [*rows, *odd]], SCHEMA)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    formatted = "".join(f"<|im_start|>{chat_tree.escape_role(r)}\n{chat_tree.escape(t)}<|im_end|>\n" for r, t in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)


@pytest.fixture(scope="module")
def convs():
    rnd = random.Random(12)
    turn = lambda: (rnd.choice(ROLES), rnd.choice(TEXTS))
    out = {}
    for c in range(250):
        old = out[rnd.choice(list(out))] if out and rnd.random() < 0.7 else []
        out[c] = [*old[: rnd.randint(0, len(old))], *[turn() for _ in range(rnd.randint(0, 3))]] or [turn()]
    deep = [turn() for _ in range(60)]
    return out | {c: deep[: rnd.randint(30, 60)] for c in range(300, 310)} | {c: out[3] for c in range(400, 600)}


@pytest.mark.parametrize("block_turns", [10**6, 60, 5])
def test_round_trip_and_tree(spark, convs, block_turns):
    segments, members = chat_tree.trees(table(spark, convs), PATH, block_turns=block_turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_conversations(segments, members, PATH).collect()}
    assert got == {c: digest(turns) for c, turns in convs.items()}
    rows = sorted(segments.collect(), key=lambda r: r["segment"])
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    cost = lambda r, x: ids(f"<|im_start|>{chat_tree.escape_role(r)}\n") + ids(chat_tree.escape(x)) + ids("<|im_end|>\n")
    prefixes = {tuple(turns[:d]) for turns in convs.values() for d in range(1, len(turns) + 1)}
    assert sum(r["n_tokens"] for r in rows) == sum(cost(*p[-1]) for p in prefixes)  # each prefix of turns is there once
    end, trees = 0, {}
    for r in rows:  # one stream without gaps, tree by tree
        assert r["segment"] == end and r["tree"] + r["start"] == end and len(r["ids"]) == 4 * r["n_tokens"]
        assert r["position"] == sum(a["to"] - a["from"] for a in r["attends"]) and all(a["to"] <= r["start"] for a in r["attends"])
        trees.setdefault(r["tree"], set()).update(range(r["start"], r["start"] + r["n_tokens"]))
        end += r["n_tokens"]
    assert len(trees) == len({turns[0] for turns in convs.values()}) and all(x == set(range(len(x))) for x in trees.values())
    start = {r["tree"] + r["start"]: r for r in rows}
    of = {r["conv_id"]: start[r["segment"]] for r in members.collect()}
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    for c, turns in convs.items():  # intervals give the conversation's own tokens, in order
        r = of[c]
        spans = [(a["from"], a["to"]) for a in r["attends"]] + [(r["start"], r["start"] + r["n_tokens"])]
        text = t.decode(np.concatenate([stream[r["tree"] + a : r["tree"] + b] for a, b in spans]).tolist(), skip_special_tokens=False)
        assert chat_tree.parse(text) == list(turns)


def test_odd_rows(spark, tmp_path):
    long = "word <| " * 300_000
    convs = {1: [("assistant", long)], 2: [("user", ""), ("assistant", "")], -7: [("assistant", "x")]}
    extra = (1, "x", 2, "y")
    odd = [(None, 0, "user", "of nobody", *extra), (None, 1, "assistant", "too", *extra), (9, None, "user", "first", *extra), (9, 0, "user", "twice", *extra), (9, 0, "user", "twice", *extra)]
    table(spark, convs, odd).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_chat_tree(spark, str(tmp_path)).collect()}
    told = "<|im_end|><|im_start|>assistant ok"
    full = convs | {None: [("user", "of nobody"), ("assistant", "too")], 9: [("user", "first"), ("user", "twice"), ("user", "twice")], -1: [("user", told), ("assistant", told)]}
    assert got == {c: digest(turns) for c, turns in full.items()}
    segments, members = chat_tree.trees(table(spark, {}), PATH)
    assert segments.count() == 0 and chat_tree.read_conversations(segments, members, PATH).count() == 0


def test_escapes():
    rnd = random.Random(2)
    for _ in range(3000):
        x = "".join(rnd.choice(["<", "|", "\\", "\n", "n", "im_end", ">"]) for _ in range(rnd.randint(0, 12)))
        assert chat_tree.unescape(chat_tree.escape(x)) == x and chat_tree.unescape_role(chat_tree.escape_role(x)) == x
        assert "<|" not in chat_tree.escape(x) and "\n" not in chat_tree.escape_role(x)
    with pytest.raises(ValueError):
        chat_tree.parse("<|im_start|>user\nno end")
