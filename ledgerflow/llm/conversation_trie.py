"""Conversation prefix trie without a stack: sparse-table range minima over the longest common prefixes of sorted conversations.

Distinct conversations stand in sorted order, so a prefix's members are a run of them. Every place where two neighbours part is a
candidate prefix (what they share), and so is every whole conversation; each candidate finds the left and the right end of its run by
its own binary search in the sparse table. A candidate stands for the chain of depths down from its parent, which have the same run.

The order is cut into blocks, which Spark works on side by side. A prefix that crosses a border is open: it is named by the block where
its run begins, found by the same search over one number per block, and its parts are added up by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import prefixes
from .common import forget, stored

#: Conversations whose ids share all but this many low bits are listed together before their hash is taken.
LIST_BITS = 9
#: Open prefixes that are broadcast at most; more are joined by a shuffle.
OPEN_ROWS = 500_000
_NONE = hashlib.sha256(b"").hexdigest()
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def sequences(turns: DataFrame) -> DataFrame:
    """conv, names and words of its turns; a null turn is first, and equal turns stand in the order of their names."""
    one = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "words"))).alias("t"))
    return one.select("conv", F.col("t.name").alias("names"), F.col("t.words").alias("words"))


def rebuilt(rows: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own: h is crc32(c) % heads."""
    head = lambda c: F.slice(c, 1, heads - 1)
    base = rows.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), head("names").alias("base_names"), head("words").alias("base_words"))
    rows = rows.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", (F.crc32(F.col("conv").cast("string")) % heads).cast("int"))

    def joined(own: str, other: str):
        start = F.when(F.col("h") > 0, F.slice(F.coalesce(other, F.slice(own, 1, 0)), F.lit(1), F.col("h"))).otherwise(F.slice(own, 1, 0))
        return F.concat(start, F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))).alias(own)

    return rows.join(base, "base", "left").select("conv", joined("names", "base_names"), joined("words", "base_words"))


def _ends(members: DataFrame, shared: DataFrame) -> DataFrame:
    """sid, ends: SHA-256 of the ids of the conversations that are equal, in numeric order. members: sid, conv.

    Ids are listed in short runs first, so that a sequence of very many conversations is few rows, which one pass hashes in order.
    """
    part = members.withColumn("part", F.shiftright("conv", LIST_BITS)).groupBy("sid", "part").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    part = part.join(shared.select("sid"), "sid", "left_semi").select("sid", "part", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        last, state = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for sid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sid == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out[0].append(last)
                    out[1].append(state.hexdigest())
                last, state = sid, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["sid", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["sid", "ends"])

    return part.repartition("sid").sortWithinPartitions("sid", "part").select("sid", "ids").mapInArrow(run, "sid string, ends string")


def runs_of(shared: np.ndarray, size: np.ndarray, left: int, right: int) -> tuple[np.ndarray, ...]:
    """(first, last, over, depth) of the runs whose prefixes do not cross the block's borders, in the order of (first, depth).

    A run's prefixes are those of depth over + 1 to depth. shared[i] is what place i shares with the one before, left and right what
    the block's first and last place share with their neighbours outside (none: -1).
    """
    m = len(size)
    table = prefixes.RangeMin(shared)
    inside, whole = np.arange(1, m), np.arange(m)
    at, depth = np.concatenate([inside, whole]), np.concatenate([shared[1:], size])
    first, last = table.left(at, depth), table.right(at, depth)
    edge = np.concatenate([[left], shared[1:], [right]])
    over = np.maximum(edge[first], edge[last + 1])
    own = over < depth
    _, one = np.unique(np.stack([first, depth])[:, own], axis=1, return_index=True)  # sorted by first, then by depth
    pick = np.flatnonzero(own)[one]
    return first[pick], last[pick], over[pick], depth[pick]


def block_nodes(keys: list[bytes], words: list, count: np.ndarray, least: np.ndarray, ends: list, place: int, edges: prefixes.Borders) -> dict[str, list | np.ndarray]:
    """The nodes of one block: whole ones, and what it adds to open ones."""
    left, right = int(edges.left[place]), edges.right(place)
    back = prefixes.RangeMin(np.minimum(edges.left, edges.inner))
    ahead = prefixes.RangeMin(np.minimum(edges.inner, np.append(edges.left[1:], -1)))
    size, shared = prefixes.lengths_and_prefixes(keys)
    m, table, smallest = len(size), prefixes.RangeMin(shared), prefixes.RangeMin(least)
    start = np.concatenate([[0], np.cumsum(size)])
    spoken = np.concatenate([[0], np.cumsum(np.concatenate([np.asarray(w, np.int64) for w in words]) if m else [])]).astype(np.int64)
    convs = np.concatenate([[0], np.cumsum(count)])
    leaf = np.append(shared[1:], right) < size
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    by = np.lexsort((np.arange(m), shared))  # places in the order of (shared, place): branches of a depth in a run are a slice
    mark = shared[by] * (m + 1) + by
    branches = lambda first, last, depth: np.searchsorted(mark, depth * (m + 1) + last, "right") - np.searchsorted(mark, depth * (m + 1) + first, "right")

    first, last, over, depth = runs_of(shared, size, left, right)
    n = convs[last + 1] - convs[first]
    chain = (n - 1) * (spoken[start[first] + depth] - spoken[start[first] + np.maximum(over, 0)])
    sums = np.concatenate([[0], np.cumsum(chain)])
    below = sums[np.searchsorted(first, last, "right")] - sums[1:] if len(first) else chain  # runs inside stand behind, up to the last place
    low = smallest.minimum(first, last)
    run = np.repeat(np.arange(len(first)), depth - over)
    d = over[run] + 1 + np.arange(len(run)) - np.repeat(np.cumsum(depth - over) - (depth - over), depth - over)
    f, e = first[run], last[run]
    saved = (n[run] - 1) * (spoken[start[f] + depth[run]] - spoken[start[f] + np.maximum(d - 1, 0)]) + below[run]
    deepest = d == depth[run]
    children = np.where(deepest, (size[f] > d) + branches(f, e, d), 1)
    parent, parent_open = low[run].copy(), np.full(len(run), -1, np.int64)
    top = np.flatnonzero((d == over[run] + 1) & (d > 0))
    pl, pr = table.left(f[top], d[top] - 1), table.right(f[top], d[top] - 1)
    parent[top] = smallest.minimum(pl, pr)
    from_left, to_right = (pl == 0) & (d[top] - 1 <= left), (pr == m - 1) & (d[top] - 1 <= right)
    parent_open[top[to_right]] = place
    at = top[from_left]
    parent_open[at] = back.left(np.full(len(at), place - 1), d[at] - 1)

    # Open prefixes: of the first place up to left, of the last one up to right; one that is both counts as of the first.
    od = np.concatenate([np.arange(left + 1), np.arange(right + 1)])
    side = np.repeat([0, 1], [left + 1, right + 1])
    place_of = np.where(side == 0, 0, m - 1)
    of, ol = table.left(place_of, od), table.right(place_of, od)
    keep = (side == 0) | (of > 0) | (od > left)
    od, of, ol = od[keep], of[keep], ol[keep]
    begun = (of == 0) & (od <= left)
    owner = np.where(begun, -1, place)
    owner[begun] = back.left(np.full(begun.sum(), place - 1), od[begun])
    above = np.full(len(od), -1, np.int64)
    mine = np.flatnonzero(~begun & (od > 0))
    higher = table.left(of[mine], od[mine] - 1)
    above[mine] = place
    outside = mine[(higher == 0) & (od[mine] - 1 <= left)]
    above[outside] = back.left(np.full(len(outside), place - 1), od[outside] - 1)
    until = np.where(begun, -1, place)
    until[~begun] = ahead.right(np.full((~begun).sum(), place), od[~begun])
    o_children = branches(of, ol, od) + ((size[of] > od) & ((of > 0) | (od + 1 > left)))
    o_saved = sums[np.searchsorted(first, ol, "right")] - sums[np.searchsorted(first, of, "left")]
    hashes = lambda places, depths, none: [ends[p] if size[p] == x else none for p, x in zip(places.tolist(), depths.tolist(), strict=True)]
    # The root has no text and no parent.
    said = np.where(od > 0, spoken[start[of] + od] - spoken[start[of] + np.maximum(od - 1, 0)], 0)
    both = lambda a, b: np.concatenate([a, b]).astype(np.int64)
    none = np.zeros(len(run), np.int64)
    return {
        "open": np.repeat([False, True], [len(run), len(od)]),
        "owner": both(none + place, owner), "depth": both(d, od), "conv_id": both(low[run], smallest.minimum(of, ol)),
        "parent_conv_id": pa.array(both(parent, np.zeros(len(od))), mask=np.concatenate([d == 0, np.ones(len(od), bool)])),
        "parent_open": both(parent_open, above), "until": both(none, until), "words": both(none, said),
        "n_convs": both(n[run], convs[ol + 1] - convs[of]), "n_children": both(children, o_children),
        "n_leaves": both(leaves[e + 1] - leaves[f], leaves[ol + 1] - leaves[of]), "saved_tokens": both(saved, o_saved),
        "ends_sha256": hashes(f, d, _NONE) + hashes(of, od, None),
    }


_NODES = "open boolean, owner long, depth long, conv_id long, parent_conv_id long, parent_open long, until long, words long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild=rebuilt, block_turns: int = prefixes.BLOCK_TURNS
) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256, as the trie of all conversations has them; rebuild (None: as they are) changes them first.

    Rows with a null conv_id belong to no conversation; a null turn is first, and turns of one number (repeated rows too, each is a
    turn) stand in the order of their names, a hash of role and text; a null role or text is empty. A conversation without turns is a
    member of the root alone. Other columns are not read. An empty table gives an empty result. saved_tokens: over the subtree, what
    every node would cost again for all members but one, in words of its last text. A conversation's turns take 24 bytes each in
    the task that sorts them.
    """
    turns = prefixes.turns_of(conversations.where(F.col(conv_id).isNotNull()), conv_id, turn, role, text).drop("role", "text")
    plain = sequences(turns)
    rows = (rebuild(plain) if rebuild else plain).select("conv", prefixes.key_of(F.col("names")).alias("key"), "words")
    rows = stored(rows.withColumn("sid", F.md5("key")))
    distinct = stored(rows.groupBy("sid", "key", "words").agg(F.count("*").alias("count"), F.min("conv").alias("least")))
    ends = _ends(rows.select("sid", "conv"), distinct.where("count > 1"))
    distinct_ends = distinct.join(ends, "sid", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.col("least").cast("string"), 256)))
    ordered = prefixes.ordered_blocks(distinct_ends.select("key", "words", "count", "least", "ends"), block_turns)
    edges = prefixes.borders(ordered)

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block.column("key")))
        get = lambda name: block.column(name).to_numpy()
        place = edges.place(block.column("block")[0].as_py())
        found = block_nodes(block.column("key").to_pylist(), block.column("words").to_pylist(), get("count"), get("least"), block.column("ends").to_pylist(), place, edges)
        return pa.table(found)

    nodes = stored(ordered.groupBy("block").applyInArrow(run, _NODES))
    opened = nodes.where("open").groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("parent_open", "until", "words", "ends_sha256")], *[F.sum(c).alias(c) for c in _SUMS])
    weight = (F.col("n_convs") - 1) * F.col("words")
    inner = F.sum(weight).over(W.partitionBy("owner").orderBy(F.desc("depth")))
    opened = stored(opened.withColumn("within", inner))
    # What open nodes of later blocks add: one number a block, summed up to each (MAX_BLOCKS numbers at most).
    total = np.zeros(len(edges.block) + 1, np.int64)
    for r in opened.groupBy("owner").agg(F.max("within").alias("w")).collect():
        total[r["owner"] + 1] = r["w"]
    upto = F.broadcast(conversations.sparkSession.createDataFrame([(i - 1, int(x)) for i, x in enumerate(np.cumsum(total))], "at long, upto long"))
    joined = opened.join(upto.withColumnRenamed("at", "until").withColumnRenamed("upto", "high"), "until").join(upto.withColumnRenamed("at", "owner").withColumnRenamed("upto", "low"), "owner")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    up = opened.select(F.col("owner").alias("parent_open"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    up = F.broadcast(up) if up.count() <= OPEN_ROWS else up
    crossing = joined.withColumn("saved_tokens", F.col("saved_tokens") + F.col("within") + F.col("high") - F.col("low")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    crossing = crossing.join(up, ["parent_open", "depth"], "left").withColumn("parent_conv_id", F.col("above"))
    inside = nodes.where("not open and parent_open < 0")
    beneath = nodes.where("not open and parent_open >= 0").join(up, ["parent_open", "depth"]).withColumn("parent_conv_id", F.col("above"))
    done = stored(inside.select(names).unionByName(beneath.select(names)).unionByName(crossing.select(names)))
    forget(rows, distinct, ordered, nodes, opened)
    return done
