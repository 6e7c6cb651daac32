"""Hard negatives by lists that a cluster of anchors shares: candidates sorted once by an angular upper bound of their scores.

Anchors are clustered by direction. For a cluster with center c, whose members lie within the angle t of c, no member a scores more
than |a| |x| cos(max(0, angle(x, c) - t)) with a candidate x. Candidates are sorted by that bound, without |a|, once for the cluster,
and every member walks the same list until what is still to come can't change its result: that is its certificate. Clusters meet
chunks of candidates (a stated set of anchors against all rows, in blocks), so a list covers the candidates of one chunk, and the
best few of each chunk are merged by Spark. Scores are exact integers; the bound only says where to stop.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, stored

#: Anchors of a group and candidates of a chunk, about; they meet in one task.
GROUP, CHUNK = 8192, 16_384
#: Clusters at most, anchors of a cluster on average, and anchors that centers are fitted on at most.
CLUSTERS, PER_CLUSTER, FIT_ROWS = 256, 64, 4096
#: Candidates of the list that are scored at once.
STEP = 2048
_LOW = np.int64(-(2**63))


def quantised(df: DataFrame, id_col: str, vector: str, label: str, is_anchor: Column) -> DataFrame:
    """id, label, anchor, v (floor(256 * x) of each component) of the rows that take part."""
    x = F.transform(F.col("x"), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null").withColumn("x", x)
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = np.clip(np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False)), -(2.0**62), 2.0**62).astype("<i8")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            large = np.concatenate([[0], np.cumsum(np.abs(flat) >= 2**15)])
            small, full, many = flat.astype("<i2").tobytes(), flat.tobytes(), large[ends] > large[starts]  # two bytes a component are nearly always enough
            v = [b"l" + full[8 * i : 8 * j] if m else b"s" + small[2 * i : 2 * j] for i, j, m in zip(starts.tolist(), ends.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(v, pa.binary())], names=["id", "label", "anchor", "v"])

    return rows.mapInArrow(run, "id long, label long, anchor boolean, v binary")


def _matrix(column, width: int = 0) -> np.ndarray:
    """Vectors as rows of longs; shorter ones are filled with zeros."""
    rows = [np.frombuffer(b, "<i2" if b[:1] == b"s" else "<i8", offset=1) for b in column.to_pylist()]
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _directions(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(m.astype(float), axis=1)
    return m / np.maximum(norm, 1e-300)[:, None], norm


def fit_centers(rows: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k directions by spherical k-means, from the same start every time."""
    unit, _ = _directions(rows)
    centers = unit[np.linspace(0, len(unit) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (unit @ centers.T).argmax(1)
        for c in range(k):
            total = unit[own == c].sum(0)
            if (size := np.linalg.norm(total)) > 0:
                centers[c] = total / size
    return centers


def shared_list(center: np.ndarray, anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bound): candidates by falling bound; |a| * bound[i] is at least what anchor a scores with any from order[i] on."""
    a, a_norm = _directions(anchors)
    x, x_norm = _directions(candidates)
    angle = lambda u: np.arccos(np.clip(u @ center, -1, 1))
    radius = angle(a[a_norm > 0]).max(initial=0)
    bound = x_norm * np.cos(np.maximum(angle(x) - radius - 1e-7, 0))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(center: np.ndarray, anchors: np.ndarray, candidates: np.ndarray, ids: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, allowed, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, score, id) of the k best candidates of each target: scores from low to high, higher first, ties by smaller id.

    A target is a wish of the anchor target[t]; allowed(anchor, candidate) says, for two index arrays, which pairs count at all.
    """
    order, bound = shared_list(center, anchors, candidates)
    norm = np.linalg.norm(anchors.astype(float), axis=1)
    exact = anchors.shape[1] * float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) < 2**53
    kind = float if exact else np.int64
    left, right = anchors.astype(kind), candidates.astype(kind)
    best = (np.zeros(0, np.int64),) * 3
    least = low.copy()  # what a score must reach to matter to a target
    for at in range(0, len(order), STEP):
        reach = norm[target] * bound[at]
        live = np.flatnonzero((least <= high) & (reach + np.abs(reach) * 1e-9 + 0.5 >= least))
        if not len(live):
            break  # certified for all members
        members, row = np.unique(target[live], return_inverse=True)
        part = order[at : at + STEP]
        score = (left[members] @ right[part].T)[row]
        t, c = np.nonzero((score >= least[live][:, None]) & (score <= high[live][:, None]))
        t, s, c = live[t], score[t, c].astype(np.int64), part[c]
        ok = allowed(target[t], c)
        t, s, i = (np.concatenate(pair) for pair in zip(best, (t[ok], s[ok], ids[c[ok]]), strict=True))
        by = np.lexsort((i, -s, t))
        t, s, i = t[by], s[by], i[by]
        place = np.arange(len(t)) - np.searchsorted(t, t)
        best = tuple(x[place < k] for x in (t, s, i))
        last = place == k - 1
        least[t[last]] = np.maximum(least[t[last]], s[last])
    return best


def _meet(chunks: DataFrame, groups: DataFrame, n_chunks: int, n_groups: int, centers: np.ndarray, positive: bool, k: int, low_percent: int) -> DataFrame:
    """(a, wish, score, id): best candidates of each anchor's wishes, k of each chunk at most. A wish is a positive's score, or 0."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("group", every(n_groups)).groupBy("chunk", "group")
    right = groups.withColumn("chunk", every(n_chunks)).groupBy("chunk", "group")
    names = ["a", "wish", "score", "id"]

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        get = lambda table, name: table.column(name).to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if len(x) and len(q):
            vectors = _matrix(q.column("v"), centers.shape[1])
            candidates = _matrix(x.column("v"), vectors.shape[1])
            vectors = np.pad(vectors, ((0, 0), (0, candidates.shape[1] - vectors.shape[1])))
            around = np.pad(centers, ((0, 0), (0, candidates.shape[1] - centers.shape[1])))
            ids, labels = get(x, "id"), get(x, "label")
            a, a_ids, a_labels, cluster = (get(q, n) for n in ("a", "id", "label", "cluster"))
            wishes = q.column("wishes").to_pylist()
            for c in np.unique(cluster):
                own = np.flatnonzero(cluster == c)
                target = np.repeat(np.arange(len(own)), [len(wishes[i]) for i in own])
                wish = np.array([w for i in own for w in wishes[i]], np.int64)
                if positive:
                    low, high = np.full(len(target), _LOW), np.full(len(target), np.int64(2**63 - 1))
                    allowed = lambda r, y: (labels[y] == a_labels[own[r]]) & (ids[y] != a_ids[own[r]])  # noqa: E731, B023
                else:
                    low, high = -(-low_percent * wish // 100), wish
                    allowed = lambda r, y: labels[y] != a_labels[own[r]]  # noqa: E731, B023
                t, s, i = walk(around[c], vectors[own], candidates, ids, target, low, high, allowed, k)
                for column, v in zip(out, (a[own[target[t]]], wish[t], s, i), strict=True):
                    column.append(v)
        return pa.table(dict(zip(names, map(np.concatenate, out), strict=True)))

    found = left.cogroup(right).applyInArrow(run, "a long, wish long, score long, id long")
    place = F.row_number().over(W.partitionBy("a", "wish").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(
    embeddings: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, low_percent: int = 80, group: int = GROUP, chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that is_anchor names.

    An anchor's positives are its best other rows of the same label; a positive's negatives are the best rows of other labels that
    score at most as much as it, and low_percent of it or more. Scores are inner products of floor(256 * x), as long. Rows with a
    null id, label or vector, or a null or non-finite component, take no part. A shorter vector counts as filled with zeros, and
    a component beyond 2**62 as that. Rows
    with the anchor's id are not other rows; otherwise a row that is there twice counts twice, while an equal anchor has its result
    once. Ties go to the smaller id. Other columns are not read. An empty table, or one without anchors, gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = stored(quantised(embeddings, id_col, vector, label, is_anchor))
    anchors = stored(rows.where("anchor").select("id", "label", "v").distinct())
    n, total = anchors.count(), rows.count()
    # Centers are fitted on FIT_ROWS anchors at most; every anchor is assigned, and results do not depend on them.
    sample = anchors.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("v").toArrow()
    centers = fit_centers(_matrix(sample.column("v"), 1), max(1, min(CLUSTERS, math.ceil(n / PER_CLUSTER), len(sample)))) if n else np.zeros((1, 1))

    def assign(batches):
        for batch in batches:
            unit, _ = _directions(_matrix(batch.column(2), centers.shape[1]))
            nearest = (unit[:, : centers.shape[1]] @ centers.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    placed = anchors.mapInArrow(assign, "id long, label long, v binary, cluster int")
    placed = stored(placed.select(F.monotonically_increasing_id().alias("a"), "*"))
    # Clusters (CLUSTERS at most) go into groups; one that is larger than a group is spread over several.
    plan, first, used = [], 0, 0
    for c, size in sorted((r["cluster"], r["n"]) for r in placed.groupBy("cluster").agg(F.count("*").alias("n")).collect()):
        if used and used + size > group:
            first, used = first + 1, 0
        parts = math.ceil(size / group)
        plan.append((c, first, parts))
        first, used = (first + parts, 0) if parts > 1 else (first, used + size)
    n_groups, n_chunks = max(1, first + (used > 0)), max(1, math.ceil(total / chunk))
    where = F.broadcast(spark.createDataFrame(plan, "cluster int, first int, parts int"))  # CLUSTERS rows at most
    groups = placed.join(where, "cluster").withColumn("group", F.col("first") + F.pmod(F.hash("a"), F.col("parts"))).drop("first", "parts")
    chunks = rows.select("id", "label", "v", F.pmod(F.monotonically_increasing_id(), F.lit(n_chunks)).cast("int").alias("chunk"))
    found = stored(_meet(chunks, groups.withColumn("wishes", F.array(F.lit(0).cast("long"))), n_chunks, n_groups, centers, True, positives, low_percent))
    asked = groups.join(found.groupBy("a").agg(F.collect_set("score").alias("wishes")), "a")  # a score for each positive at most
    hard = _meet(chunks, asked, n_chunks, n_groups, centers, False, negatives, low_percent).select("a", F.col("wish").alias("score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    pairs = found.select("a", F.col("id").alias("positive_id"), "score").join(placed.select("a", F.col("id").alias("anchor_id")), "a")
    done = stored(pairs.join(hard, ["a", "score"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"))
    forget(rows, anchors, placed, found)
    return done
