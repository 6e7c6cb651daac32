"""Conversations as sequences of turns in sorted order: turn names, blocks of the order, longest common prefixes, range minima.

A turn is named by 16 bytes of its role and text, a sequence by the names of its turns in a row, so Spark sorts sequences as bytes and
neighbours share prefixes. The order is cut into blocks; of each block only its first and last sequence and two numbers leave it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

#: Turns of a block about, and blocks at most; numbers kept per block (five of them) are then bounded too.
BLOCK_TURNS, MAX_BLOCKS = 1_000_000, 32_768
NAME = 16


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text (null: empty), name (hex), words of the text."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    name = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    return rows.select("*", name.alias("name"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def key_of(names):
    """The sort key of an array of turn names."""
    return F.unhex(F.array_join(names, ""))


def ordered_blocks(sequences: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The rows (key: distinct) stored in sorted order, with block: blocks are runs of the order."""
    turns = sequences.agg(F.sum(F.octet_length("key") / NAME)).first()[0] or 0
    blocks = max(1, min(MAX_BLOCKS, math.ceil(turns / block_turns)))
    return stored(sequences.repartitionByRange(blocks, "key").sortWithinPartitions("key").withColumn("block", F.spark_partition_id()))


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(k, "V16", n) for k in (a, b))
    return int(np.argmin(same)) if not (same := x == y).all() else n


@dataclass
class Borders:
    """Of each block: its number, the prefix that its first sequence shares with the block before (none: -1), and that its own share."""

    block: np.ndarray
    left: np.ndarray
    inner: np.ndarray

    def place(self, block: int) -> int:
        return int(np.searchsorted(self.block, block))

    def right(self, place: int) -> int:
        return int(self.left[place + 1]) if place + 1 < len(self.left) else -1


def borders(ordered: DataFrame) -> Borders:
    """MAX_BLOCKS rows at most: all sequences of a sorted block share what its first and its last one share."""
    ends = ordered.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")).repartition(1).sortWithinPartitions("block")

    def run(batches):
        before = None
        for batch in batches:
            out = []
            for block, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((block, -1 if before is None else common_prefix(before, low), common_prefix(low, high)))
                before = high
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (zip(*out, strict=True) if out else ([], [], []))], names=["block", "left", "inner"])

    found = ends.mapInArrow(run, "block int, left int, inner int").toArrow().sort_by("block")
    return Borders(*(found.column(c).to_numpy().astype(np.int64) for c in ("block", "left", "inner")))


def lengths_and_prefixes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(turns of each key, turns that each key shares with the one before; the first: 0), keys in sorted order."""
    size = np.array([len(k) // NAME for k in keys], np.int64)
    shared = np.zeros(len(keys), np.int64)
    short = np.minimum(size[1:], size[:-1])
    some = np.flatnonzero(short) + 1
    if len(some):
        names = np.frombuffer(b"".join(keys), "V16")
        start, n = np.cumsum(size) - size, short[some - 1]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first, n)
        same = names[np.repeat(start[some], n) + at] == names[np.repeat(start[some - 1], n) + at]
        shared[some] = np.minimum(np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, at), first), n)
    return size, shared


class RangeMin:
    """Sparse table of minima: row j holds the minimum of each run of 2**j values."""

    def __init__(self, values: np.ndarray):
        self.rows, n = [np.asarray(values)], len(values)
        while 2 ** len(self.rows) <= n:
            v, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(v[: n - 2 * half + 1], v[half : n - half + 1]))

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of values low to high, both included."""
        out = np.empty(len(low), self.rows[0].dtype)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for j in np.unique(level):
            own = level == j
            out[own] = np.minimum(self.rows[j][low[own]], self.rows[j][high[own] - 2**j + 1])
        return out

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place whose way to at is not below depth: a binary search; values[i] stands between places i - 1 and i."""
        at = np.array(at, np.int64)
        for j in range(len(self.rows) - 1, -1, -1):
            start = at - 2**j + 1
            ok = start >= 1
            ok[ok] = self.rows[j][start[ok]] >= depth[ok]
            at[ok] -= 2**j
        return at

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place that can be reached from at without going below depth."""
        at, n = np.array(at, np.int64), len(self.rows[0])
        for j in range(len(self.rows) - 1, -1, -1):
            ok = at + 2**j < n
            ok[ok] = self.rows[j][at[ok] + 1] >= depth[ok]
            at[ok] += 2**j
        return at
