"""Sharding by fixed virtual slots: records hash into slots, bytes are summed per slot, and a versioned map gives each slot a shard.

Slots never change; rebalancing edits the map. Version 1 deals the slots out evenly, version 2 moves slots until the shards'
bytes are near equal. The number of slots is fixed, so the map and the sums stay small whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, partitions, shared_dir

SLOTS, SHARDS, ROW_OVERHEAD = 8192, 24, 8
#: Bytes that one task is to sort and write.
TASK_BYTES = 64 << 20


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> dict[int, int]:
    return {s: s % shards for s in range(slots)}


def rebalanced(slot_map: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map whose shards have near equal bytes: overfull shards give slots away, then pairs of shards trade.

    Slots without bytes stay where they are. Also used to grow: with one more shard the others give slots to it.
    """
    out = dict(slot_map)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, n in sorted(sizes.items()):
        load[out[s]] += n
        held[out[s]].append((n, s))
    mean = sum(load) / shards
    pool = []
    for k in range(shards):
        for n, s in sorted(held[k], reverse=True):
            if load[k] - n >= mean or (load[k] > mean and load[k] - mean > n / 2):
                held[k].remove((n, s))
                load[k] -= n
                pool.append((n, s))
    for n, s in sorted(pool, reverse=True):
        k = min(range(shards), key=load.__getitem__)
        load[k] += n
        held[k].append((n, s))
        out[s] = k
    for x in held:
        x.sort()
    for _ in range(4 * len(sizes)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        want = (load[hi] - load[lo]) / 2
        best, trade = want, None  # how far from even the two end up
        for n, s in held[hi]:
            for j in {0, bisect_left(held[lo], (n - want, -1)), bisect_left(held[lo], (n - want, -1)) - 1}:
                if 0 <= j < len(held[lo]) and abs(want - (n - held[lo][j][0])) < best - 0.5:
                    best, trade = abs(want - (n - held[lo][j][0])), ((n, s), held[lo][j])
            if abs(want - n) < best - 0.5:
                best, trade = abs(want - n), ((n, s), None)
        if trade is None:
            break
        for item, a, b in ((trade[0], hi, lo), (trade[1], lo, hi)):
            if item:
                held[a].remove(item)
                held[b].append(item)
                held[b].sort()
                load[a] -= item[0]
                load[b] += item[0]
                out[item[1]] = b
    return out


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int], stats: dict[int, tuple[int, int]]) -> None:
    """Store one version: virtual_slot, shard, bytes and rows of the slot, and first, the rows of the shard's earlier slots."""
    rows, first = [], {}
    for s in sorted(slot_map):
        size, n = stats.get(s, (0, 0))
        rows.append((s, slot_map[s], size, n, first.get(slot_map[s], 0)))
        first[slot_map[s]] = first.get(slot_map[s], 0) + n
    spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long, rows long, first long").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def shard_documents(docs: DataFrame, out: str | None = None, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text") -> tuple[str, str]:
    """Write docs as Parquet below <out>/shards/shard=N and the map below <out>/map/version=V; returns both folders (see read_shards).

    Law: bytes. A record's size is its UTF-8 bytes (null: none) plus ROW_OVERHEAD. The virtual slot is the hash of the id, or of
    the text where the id is null. Each row also gets `slot`, its gapless place in its shard (by virtual slot, id and text).
    Repeated rows, which are of one slot, take a place each. A group of equal texts is spread by its ids: a shard that had to hold
    all copies of a third of the bytes could not be as large as the others. Columns of docs with the names of added ones are
    replaced; an empty table writes maps and no shard. Tasks grow in number with the bytes, down to one slot each.
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark)
    plain, names = numbered(docs)
    own = [(f"c{i}", c) for i, c in enumerate(names) if c not in ("virtual_slot", "shard", "slot")]
    key, x = (f"c{names.index(c)}" for c in (id_col, text))
    hashed = F.when(F.col(key).isNull(), F.xxhash64(x)).otherwise(F.xxhash64(key))
    rows = plain.withColumn("virtual_slot", F.pmod(hashed, F.lit(slots)).cast("int"))
    size = F.coalesce(F.octet_length(x), F.lit(0)).cast("long") + ROW_OVERHEAD
    stats = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in rows.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).collect()}
    even = first_map(slots, shards)
    write_map(spark, f"{out}/map", 1, even, stats)
    write_map(spark, f"{out}/map", 2, rebalanced(even, {s: b for s, (b, _) in stats.items()}, shards), stats)
    current = read_map(spark, f"{out}/map", 2).select("virtual_slot", "shard", "first")
    n = max(partitions(spark), -(-sum(b for b, _ in stats.values()) // TASK_BYTES))
    per_shard = 4 * -(-n // shards)  # tasks that share a shard's slots
    placed = rows.join(F.broadcast(current), "virtual_slot").withColumn("part", F.pmod(F.hash("virtual_slot"), F.lit(per_shard)))
    placed = placed.repartition(n, "shard", "part")
    order = Window.partitionBy("shard", "part", "virtual_slot").orderBy(key, F.xxhash64(x))
    placed = placed.withColumn("slot", F.row_number().over(order) + F.col("first") - 1)
    placed = placed.select(*[F.col(c).alias(name) for c, name in own], "virtual_slot", "slot", "shard")
    placed.write.partitionBy("shard").parquet(f"{out}/shards")
    return f"{out}/shards", f"{out}/map"


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The rows in the shards below folder, also where there is none: the columns of docs, virtual_slot, slot and shard."""
    own = docs.drop("virtual_slot", "shard", "slot")
    schema = own.limit(0).select("*", F.lit(0).alias("virtual_slot"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema
    return spark.read.schema(schema).parquet(folder)
