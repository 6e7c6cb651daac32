"""Chat formatting as prefix trees: conversations that start alike share their tokens, which are emitted once, depth first.

Sorted as sequences of turns, conversations stand in depth-first order: each distinct one adds a segment, the turns that it does not
share with the one before it. A segment lies at a place in its tree's token stream, has the position id of its first token (tokens
before it on its own path), and the ancestor intervals of the stream that its tokens attend to, besides those before them in the
segment. The order is cut into blocks that Spark works on side by side; what a block needs of those before it is a token count and the
path of one conversation.

A turn is <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. Inside texts and roles, "<|" gets a backslash, and
what looks like an escaped one gets one more, so no control string stands there and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefixes
from .common import forget, stored
from .tokens import encoder, slices

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_SPANS, _SPANS_DDL = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), "array<struct<`from`: long, `to`: long>>"
_CODED = "conv long, turn long, name string, n int, body int, tail int, ids binary"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    found = list(_TURN.finditer(formatted))
    if sum(len(m[0]) for m in found) != len(formatted):
        raise ValueError("not a formatted conversation")
    return [(unescape_role(m[1]), unescape(m[2])) for m in found]


def coded_turns(turns: DataFrame, path: str) -> DataFrame:
    """Tokens of each turn, and where its text starts and ends in them (body, tail; the text of other roles: 0, 0)."""

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                heads, bodies = encode([f"{START}{escape_role(r)}\n" for r in roles[a:b]]), encode([escape(t) for t in texts[a:b]])
                (tail,) = encode([f"{END}\n"])
                ids = [h + t + tail for h, t in zip(heads, bodies, strict=True)]
                n = [len(x) // 4 for x in ids]
                loss = [r == LOSS_ROLE for r in roles[a:b]]
                body = [len(h) // 4 if y else 0 for h, y in zip(heads, loss, strict=True)]
                ends = [(len(h) + len(t)) // 4 if y else 0 for h, t, y in zip(heads, bodies, loss, strict=True)]
                columns = [batch.column(c).slice(a, b - a) for c in ("conv", "turn", "name")]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int32()) for x in (n, body, ends)], pa.array(ids, pa.binary())], names=["conv", "turn", "name", "n", "body", "tail", "ids"])

    return turns.select("conv", "turn", "name", "role", "text").mapInArrow(run, _CODED)


def _cut(path: list[tuple[int, int, int, int]], depth: int, counts) -> list[tuple[int, int, int, int]]:
    """The pieces (from depth, to depth, start, end) of a path down to a depth. counts: tokens of the path's turns."""
    out = []
    for low, high, start, end in path:
        if low >= depth:
            break
        out.append((low, high, start, end) if high <= depth else (low, depth, start, start + int(sum(counts[low:depth]))))
    return out


def _fours(flat: list) -> list[tuple[int, int, int, int]]:
    return list(zip(flat[::4], flat[1::4], flat[2::4], flat[3::4], strict=True))


def _walk(block: pa.Table, shared_left: int, path: list, at: int):
    """(row, depth shared, start, path) of each conversation of a block, in order; at the end path is that of the last one."""
    counts = block.column("n").to_pylist()
    size, shared = prefixes.lengths_and_prefixes(block.column("key").to_pylist())
    shared[0] = max(shared_left, 0)
    for i, c in enumerate(counts):
        low, high = int(shared[i]), int(size[i])
        path = _cut(path, low, c)
        own = int(sum(c[low:]))
        path = [*path, (low, high, at, at + own)]
        yield i, low, at, path
        at += own


def trees(conversations: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = prefixes.BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(segments, members), both stored.

    segments: segment (its place in the whole stream), tree (that of the tree's first token), start (place in the tree), position,
    n_tokens, ids (little-endian unsigned 32-bit), attends (from, to: intervals of the tree), loss (from, to: intervals of the
    segment). members: conv_id and the segment where the conversation ends; equal conversations end in one segment.

    A null conv_id is a conversation of its own, a null turn is first, null roles and texts are empty; turns of one number (repeated
    rows too, each is a turn) stand in the order of a hash. Other columns are not read. An empty table gives empty results. The
    tokens of one conversation must fit in a task.
    """
    spark = conversations.sparkSession
    turns = coded_turns(prefixes.turns_of(conversations, conv_id, turn, role, text), path)
    t = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "n", "body", "tail", "ids"))).alias("t"))
    rows = stored(t.select(F.monotonically_increasing_id().alias("row"), "conv", prefixes.key_of(F.col("t.name")).alias("key"), *[F.col(f"t.{c}").alias(c) for c in ("n", "body", "tail", "ids")]))
    named = rows.withColumn("sid", F.md5("key"))
    distinct = stored(named.groupBy("sid", "key", "n").agg(F.min("row").alias("row")))
    ordered = prefixes.ordered_blocks(distinct, block_turns)
    edges = prefixes.borders(ordered)

    def summary(block: pa.Table) -> pa.Table:
        """A block's tokens, the depth up to which its last path comes from blocks before, and the pieces of it that the block adds."""
        block = block.sort_by("key")
        place = edges.place(block.column("block")[0].as_py())
        left = max(int(edges.left[place]), 0)
        for *_, path in _walk(block, left, [(0, left, -1, -1)] if left else [], 0):
            pass
        kept = path[0][1] if path[0][2] < 0 else 0
        counts = block.column("n")[len(block) - 1].as_py()[: max(edges.right(place), 0)]
        values = [place, path[-1][3], kept, counts, [x for p in path if p[2] >= 0 for x in p]]
        types = [*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["place", "total", "kept", "counts", "pieces"])

    found = sorted(ordered.groupBy("block").applyInArrow(summary, "place long, total long, kept long, counts array<long>, pieces array<long>").collect())
    # MAX_BLOCKS rows: each block's first place in the stream, and the path that its first conversation shares with the one before.
    carried, at, open_path, counts = [], 0, [], []
    for r in found:
        carried.append((int(edges.block[r["place"]]), at, [x for p in open_path for x in p]))
        open_path = _cut(open_path, r["kept"], counts) + [(p[0], p[1], p[2] + at, p[3] + at) for p in _fours(r["pieces"])]
        counts, at = r["counts"], at + r["total"]
        open_path = _cut(open_path, len(counts), counts)
    carry = spark.createDataFrame(carried, "block int, at long, path array<long>")

    def place_all(block: pa.Table, carry: pa.Table) -> pa.Table:
        block = block.sort_by("key")
        row, out = block.column("row").to_pylist(), []
        left = int(edges.left[edges.place(block.column("block")[0].as_py())])
        for i, low, at, path in _walk(block, left, _fours(carry.column("path")[0].as_py()), carry.column("at")[0].as_py()):
            root = path[0][2]
            before = [{"from": s - root, "to": e - root} for _, _, s, e in path[:-1]]
            out.append((row[i], at, root, at - root, sum(x["to"] - x["from"] for x in before), low, before))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 6, _SPANS], strict=True)], names=["row", "segment", "tree", "start", "position", "shared", "attends"])

    schema = f"row long, segment long, tree long, start long, position long, shared long, attends {_SPANS_DDL}"
    placed = stored(ordered.groupBy("block").cogroup(carry.groupBy("block")).applyInArrow(place_all, schema))
    joined = placed.join(rows.select("row", "n", "body", "tail", "ids"), "row")

    def cut(batches):
        keep = ["segment", "tree", "start", "position", "attends"]
        for batch in batches:
            n_tokens, ids, loss = [], [], []
            for low, n, body, tail, one in zip(*(batch.column(c).to_pylist() for c in ("shared", "n", "body", "tail", "ids")), strict=True):
                starts = np.concatenate([[0], np.cumsum(n[low:])]).tolist()
                n_tokens.append(starts[-1])
                ids.append(b"".join(one[low:]))
                loss.append([{"from": s + b, "to": s + t} for s, b, t in zip(starts, body[low:], tail[low:], strict=False) if t])
            made = [pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(loss, _SPANS)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "n_tokens", "ids", "loss"])

    segments = stored(joined.mapInArrow(cut, f"segment long, tree long, start long, position long, attends {_SPANS_DDL}, n_tokens long, ids binary, loss {_SPANS_DDL}"))
    ends = placed.join(distinct.select("row", "sid"), "row").select("sid", "segment")
    members = stored(named.select(F.col("conv").alias("conv_id"), "sid").join(ends, "sid").drop("sid"))
    forget(rows, distinct, ordered, placed)
    return segments, members


def read_paths(segments: DataFrame) -> DataFrame:
    """segment, ids, loss (spans of ids): for each segment all that its last token attends to, by its ancestor intervals."""
    own = F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n_tokens")).alias("to"))
    asked = segments.select("segment", "tree", F.explode(F.concat("attends", F.array(own))).alias("span"))
    asked = asked.select("segment", "tree", F.col("span.from").alias("start"), (F.col("span.to") - F.col("span.from")).alias("n"))
    parts = asked.join(segments.select("tree", "start", "ids", "loss"), ["tree", "start"])
    part = F.struct("start", "n", F.expr("substring(ids, 1, 4 * n)").alias("ids"), F.filter("loss", lambda x: x["to"] <= F.col("n")).alias("loss"))
    return parts.groupBy("segment").agg(F.sort_array(F.collect_list(part)).alias("parts"))


def read_conversations(segments: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what the stored tokens say, decoded and unescaped."""

    def run(batches):
        decode = encoder(path).tokenizer.decode_batch
        text_of = lambda parts: decode([np.frombuffer(x, "<u4").tolist() for x in parts], skip_special_tokens=False)
        for batch in batches:
            out: list[tuple] = []
            for segment, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (formatted,) = text_of([b"".join(p["ids"] for p in parts)])
                turns = parse(formatted)
                loss = "".join(map(unescape, text_of([p["ids"][4 * s["from"] : 4 * s["to"]] for p in parts for s in p["loss"]])))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((segment, len(turns), sha(said), len(loss), sha(loss), len(formatted)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["segment", *_DIGEST])

    _DIGEST = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    digests = read_paths(segments).mapInArrow(run, "segment long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(digests, "segment").select("conv_id", *_DIGEST)
