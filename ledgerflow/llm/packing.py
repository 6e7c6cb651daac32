"""Best-two-fit packing: fill a bin greedily, then trade its smallest document for two that fit its gap more tightly.

Pieces of one length are alike, so the plan needs only how many pieces have each length: at most `capacity` numbers, whatever
the corpus. The plan lists patterns (lengths of one bin) with how many bins take each. Every piece knows its rank among those of its
length: a task counts its own, and the tasks before it are added. Ranks are then dealt to the pattern places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long"
#: Numbers of pieces by (task, length) up to this many (16 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_COUNTS = 500_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only a text longer than capacity is cut, and the first piece takes the odd part."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(a, capacity) for a in range(first, n, capacity)]]


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """One row per piece with its ids (little-endian, 2 bytes each if all ids of the vocabulary fit, else 4), the task that made it and
    its rank among the pieces of its length there. Tasks and ranks belong together only within one writing of the rows: store them."""

    def run(batches):
        enc = encoder(tokenizer, special)
        narrow = enc.tokenizer.get_vocab_size() <= 65536 and end_id < 65536
        end = int(end_id).to_bytes(4, "little")
        task, made = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows: list[list] = [[], [], [], [], [], [], [], []]
                for doc, ids in zip(ids_of.slice(a, b - a).to_pylist(), enc.encode([t or "" for t in texts[a:b]]), strict=True):
                    ids += end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + n)]
                        kept = np.frombuffer(part, dtype="<u4").astype("<u2").tobytes() if narrow else part
                        for column, value in zip(rows, (doc, k, start, n, zlib.crc32(part), kept, task, made[n]), strict=True):
                            column.append(value)
                        made[n] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "rank")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a bin, largest first) and how many bins have each; every counted piece is in one."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    plan = []

    def largest(room: int, used: Counter) -> int:
        """The largest length that fits and has pieces beyond the used ones; 0: none."""
        for i in range(bisect_right(lengths, room) - 1, -1, -1):
            if left[lengths[i]] > used[lengths[i]]:
                return lengths[i]
        return 0

    while lengths:
        used: Counter = Counter()
        room = capacity
        while n := largest(room, used):
            used[n] += 1
            room -= n
        if room and len(used) > 0:
            smallest = min(used)
            rest = used - Counter([smallest])
            gap, best = room + smallest, (smallest, 0)
            for i in range(bisect_right(lengths, gap) - 1, -1, -1):
                a = lengths[i]
                if 2 * a <= sum(best) or sum(best) == gap:
                    break
                if left[a] > rest[a]:
                    b = largest(min(a, gap - a), rest + Counter([a]))
                    if b and a + b > sum(best):
                        best = (a, b)
            if best[1]:
                used = rest + Counter(best)
        times = min(left[n] // k for n, k in used.items())
        plan.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
        if not all(left[n] for n in used):
            lengths = [n for n in lengths if left[n]]
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, the ranks at which its places begin, and each place's first sequence id and offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            found.setdefault(n, []).append((taken[n], base, offset))
            taken[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text: str = "text", special: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(placement, placed). placement: doc_id, piece, start, length, ids_crc32, sequence_id, offset; placed: the same rows with ids.

    With special, the strings of added tokens get their own ids. A null or empty text is one piece that holds the end id. Repeated
    rows are packed one by one; equal lengths are dealt in any order. Other columns of docs are not read, so their names cannot
    clash. An empty table gives two empty results. Only the number of pieces per length goes to the driver: capacity numbers.
    """
    spark = docs.sparkSession
    pieces = stored(encode_pieces(docs, tokenizer, end_id, capacity, id_col, text, special))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = stored(per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity)))
    bases = per_task.select("length", "task", "before")
    bases = F.broadcast(bases) if per_task.count() <= BROADCAST_COUNTS else bases

    def place(batches):
        places = shared.value
        for batch in batches:
            n, rank = (batch.column(i).to_numpy() for i in (3, 5))
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            lengths, first = np.unique(n[order], return_index=True)
            for length, at in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
                starts, bases, offsets = places[length]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                seq[at], off[at] = bases[k] + rank[at] - starts[k], offsets[k]
            columns = [*batch.columns[:5], pa.array(seq), pa.array(off), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = pieces.join(bases, ["length", "task"])
    light = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")]
    return ranked.select(*light).mapInArrow(place, schema), ranked.select(*light, "ids").mapInArrow(place, schema + ", ids binary")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, doc_ids, pieces and lengths in the order of the places, n_tokens, ids (the pieces' bytes in a row)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select(
        "sequence_id",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.piece").alias("pieces"),
        F.col("p.length").alias("lengths"),
        F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_tokens"),
        F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
    )
