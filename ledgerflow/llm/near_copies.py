"""Near copies: candidates by SimHash fingerprints of the texts' five-word shingles, each link by exact Jaccard similarity.

A fingerprint has 256 bits. Tables of a few bits of it, drawn once for all, deal the fingerprints into buckets, and within a bucket all
are compared by their differing bits. The number of bits grows with the number of texts, so that buckets keep their size, and the
number of tables with it, so that a pair at the limit is as sure to meet: work grows as the texts to the power 1.24, not 2. What hangs
together is a group, and every text of a group is compared with the group's first, shingle by shingle. Texts that are no copies of the
first (few, in a group of copies) meet all others of the group in tiles of fingerprints, and pairs within the radius are compared
exactly, by what each text has more or less than the first. Only exact links join copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import forget, numbered, stored
from .tokens import slices

SHINGLE, SEED = 5, 42
#: Similarity of 0.8 or more, in whole numbers: TIMES[0] * shared >= TIMES[1] * all.
TIMES = (5, 4)
#: Pairs at 0.8 differ in SHARE of the bits, 39 of 256 on average, with a deviation of 6: so far beyond, nothing that is a copy is
#: passed over. Sets of fewer than SMALL shingles differ in more (48 where one has four and the other five).
LANES, MAX_BITS, LANE_RADIUS, SHARE, SMALL, SMALL_BITS = 4, 66, 25, 0.1515, 16, 80
#: Fingerprints of a bucket on average, at most, and of one that is compared as a whole; larger ones are cut into blocks.
BUCKET, LARGE = 8192, 32768
#: Tables are SURE times as many as a pair at 0.8 needs to meet once: with 13 bits it is missed once in 2000 times, with fewer less often.
SURE = 11.6
#: Keys of so many bits name texts that are linked without a look: the bulk of a large group of near copies, of one bucket.
LONG_BITS, LONG_TABLES = 32, 8
#: Characters of the texts that meet their group's first in one task, and texts of a block where groups meet in tiles.
PART_CHARS, BLOCK = 4_000_000, 1024


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the text's runs of SHINGLE words (all words where there are fewer), A-Z lowered."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = (stop[SHINGLE - 1 :] - 1).tolist()
    xx = xxhash.xxh64_intdigest
    return np.unique(np.array([xx(line[s:e], SEED) for s, e in zip([0, *stop[: len(words) - SHINGLE].tolist()], ends, strict=True)], np.uint64))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


_LANES = [f"l{k}" for k in range(LANES)]


def _lanes(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in _LANES], axis=1).view(np.uint64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc, th, n shingles, two sums that name the set, and the lanes of its fingerprint (zero for a text without words)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 150_000):
                sets = [shingle_hashes(t) for t in texts[a:b]]
                some = [i for i, s in enumerate(sets) if len(s)]
                lanes = np.zeros((len(sets), LANES), np.uint64)
                if some:
                    lanes[some] = simhash.majority_bits([sets[i] for i in some], LANES)
                sums = [np.array([int(_mixed(s, 500 + k).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), *[pa.array(x) for x in lanes.view(np.int64).T.copy()]],
                    names=["doc", "th", "n", "s0", "s1", *_LANES],
                )

    return docs.mapInArrow(run, "doc long, th long, n long, s0 long, s1 long, " + ", ".join(f"{c} long" for c in _LANES))


def _tables(rows: int) -> list[np.ndarray]:
    """The bits of the fingerprint that each table looks at; one table without bits is one bucket of all."""
    bits = max(0, int(np.ceil(np.log2(max(rows, 1) / BUCKET))))
    return _drawn(bits, int(np.ceil(SURE / (1 - SHARE) ** bits)) if bits else 1)


def _drawn(bits: int, tables: int) -> list[np.ndarray]:
    rnd = np.random.default_rng([SEED, bits])
    return [rnd.choice(64 * LANES, bits, replace=False) for _ in range(tables)]


def _tiles(lanes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """A row for each table: the bucket of each fingerprint, as one number with the table's."""
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")
    out = np.empty((len(tables), len(lanes)), np.int64)
    for k, at in enumerate(tables):
        out[k] = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at), dtype=np.int64)) + (k << len(at))
    return out


def _dealt(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Each node (id, n, lanes) once for each table, with its tile."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                tiles = _tiles(_lanes(part), tables)
                columns = [pa.array(np.tile(c.to_numpy(), len(tables))) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array(tiles.ravel()), *columns], names=["tile", "id", "n", *_LANES])

    return nodes.select("id", "n", *_LANES).mapInArrow(run, "tile long, id long, n long, " + ", ".join(f"{c} long" for c in _LANES))


def _large_tiles(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """Tiles of more than LARGE nodes; only counts travel."""

    def run(batches):
        for batch in batches:
            tile, n = np.unique(_tiles(_lanes(batch), tables), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(n)], names=["tile", "n"])

    counts = nodes.select("id", *_LANES).mapInArrow(run, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > LARGE).select("tile")


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether different sets of these sizes can be copies."""
    shared = np.minimum(a, b) - (a == b)
    return TIMES[0] * shared >= TIMES[1] * (a + b - shared)


def _close(n: np.ndarray, lanes: np.ndarray):
    """A check of simhash's tile comparison: bits of all lanes, as many as sets of these sizes may differ in."""

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.where(np.minimum(n[a], n[b]) < SMALL, SMALL_BITS, MAX_BITS)
        return _possible(n[a], n[b]) & (np.bitwise_count(lanes[a] ^ lanes[b]).sum(axis=1) <= most)

    return check


def _blocks(n: str, block: int):
    return F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")


def _cells(d: DataFrame) -> DataFrame:
    """Rows (id, home, xs, ys, ...) where they meet: each block x of those at home with each block y of all."""
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    home = d.where("home").withColumn("x", F.pmod("id", "xs").cast("int")).withColumn("y", every("ys"))
    away = d.withColumns({"y": F.pmod("id", "ys").cast("int"), "home": F.lit(False)}).withColumn("x", every("xs"))
    return home.unionByName(away)


def _links(label: np.ndarray, ids: np.ndarray) -> pa.Table:
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": ids[child], "b": ids[label[child]]})


def _candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes (id, n, lanes) that meet in a bucket and whose fingerprints are close.

    A large bucket is mostly one group of near copies. Keys of LONG_BITS bits join such a group to begin with; in the bucket, its rows
    meet all others, but not each other again, in blocks.
    """
    tables = _tables(nodes.count())
    rows, large = _dealt(nodes, tables), stored(_large_tiles(nodes, tables))
    given = None
    if large.isEmpty():
        cells = rows.withColumns({"home": F.lit(True), "x": F.lit(0), "y": F.lit(0)})
    else:
        long = _dealt(nodes, _drawn(LONG_BITS, LONG_TABLES))
        hubs = long.groupBy("tile").agg(F.min("id").alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
        given = stored(long.join(hubs.hint("merge"), "tile").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
        groups = simhash.components(given).select(F.col("fp").alias("id"), "root")
        hot = rows.join(large, "tile").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = hot.groupBy("tile", "root").agg(F.count("*").alias("k")).groupBy("tile").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("root", "k").alias("main"))
        sizes = sizes.where("all > most").select("tile", "main", _blocks("all", BUCKET).alias("ys"), F.greatest(F.ceil((F.col("all") - F.col("most")) / BUCKET), F.lit(1)).cast("int").alias("xs"))
        hot = hot.join(stored(sizes), "tile").withColumn("home", F.col("root") != F.col("main")).drop("root", "main")
        cells = rows.join(large, "tile", "left_anti").withColumns({"home": F.lit(True), "x": F.lit(0), "y": F.lit(0)})
        cells = cells.unionByName(_cells(hot).drop("xs", "ys"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        lanes, n = _lanes(t), t.column("n").to_numpy()
        label = simhash._compare(lanes[:, 0], t.column("home").to_numpy(), LANE_RADIUS, _close(n, lanes), n, TIMES[1] / TIMES[0])
        return _links(label, t.column("id").to_numpy())

    found = cells.groupBy("tile", "x", "y").applyInArrow(run, "a long, b long").where("a <> b").distinct()
    return found if given is None else found.unionByName(given)


def _is_copy(shared: int, a: int, b: int) -> bool:
    return TIMES[0] * shared >= TIMES[1] * (a + b - shared)


_MEMBER = "root long, id long, n long, first_n long, copy boolean, less binary, more binary, " + ", ".join(f"{c} long" for c in _LANES)


def _against_first(texts: DataFrame) -> DataFrame:
    """Each text of a group (root, id, text, lanes) against the group's first: copy says if it is one; less, more: how the sets differ."""
    parts = texts.groupBy("root").agg(F.ceil(F.sum(F.length("text")) / PART_CHARS).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    texts = texts.join(parts, "root")
    first = texts.where("id = root").select(F.col("root").alias("root"), F.col("text").alias("first"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = texts.select("root", "id", "text", *_LANES, F.pmod("id", "parts").cast("int").alias("part"))

    def run(x: pa.Table, one: pa.Table) -> pa.Table:
        top = shingle_hashes(one.column("first")[0].as_py())
        texts, out = x.column("text").to_pylist(), []
        for text in texts:
            own = shingle_hashes(text)
            less, more = np.setdiff1d(top, own, True), np.setdiff1d(own, top, True)
            out.append((len(own), len(top), _is_copy(len(own) - len(more), len(own), len(top)), less.tobytes(), more.tobytes()))
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table([x.column("root"), x.column("id"), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], *[x.column(c) for c in _LANES]], names=[c.split()[0] for c in _MEMBER.split(", ")])

    return members.groupBy("root", "part").cogroup(first.groupBy("root", "part")).applyInArrow(run, _MEMBER)


def _exact(table: pa.Table, lanes: np.ndarray):
    """The check of simhash's tile comparison: bits of all lanes first, then the sets themselves."""
    n, (first,) = table.column("n").to_numpy(), set(table.column("first_n").to_pylist())
    close = _close(n, lanes)
    less, more = ([np.frombuffer(b, np.uint64) for b in table.column(c).to_pylist()] for c in ("less", "more"))

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = close(a, b)
        for k in np.flatnonzero(ok):
            i, j = a[k], b[k]
            gone = len(less[i]) + len(less[j]) - len(np.intersect1d(less[i], less[j], True))
            ok[k] = _is_copy(first - gone + len(np.intersect1d(more[i], more[j], True)), int(n[i]), int(n[j]))
        return ok

    return check


def _rest_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between texts that are no copies of their group's first and all other texts of the group."""
    sizes = members.groupBy("root").agg(F.count("*").alias("all"), F.count_if(~F.col("copy")).alias("rest")).where("rest > 0")
    d = members.join(sizes.select("root", _blocks("all", BLOCK).alias("ys"), _blocks("rest", BLOCK).alias("xs")), "root")
    tiles = _cells(d.withColumn("home", ~F.col("copy"))).groupBy("root", "x", "y")

    def run(t: pa.Table) -> pa.Table:
        lanes = _lanes(t)
        return _links(simhash._compare(lanes[:, 0], t.column("home").to_numpy(), LANE_RADIUS, _exact(t, lanes)), t.column("id").to_numpy())

    return tiles.applyInArrow(run, "a long, b long").where("a <> b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component of near copies the one with the smallest id, of its repeated rows one.

    Two texts are near copies where the Jaccard similarity of their sets of five-word shingles (A-Z lowered; all words where there
    are fewer than five) is 0.8 or more. Every link is exact; a pair at 0.8 is missed once in 2000 times at most, less often
    above and in smaller tables (up to 67 million texts; where one has eight words and the other nine, once in 100 times at most).
    Of two texts with one id the one with the smaller hash is first. A null id counts as the largest. Texts without words (null,
    empty, white space) are copies of each other. All columns come back, whatever their names. An empty table gives an empty result.
    """
    plain, names = numbered(docs)
    key, x = (f"c{names.index(c)}" for c in (id_col, text))
    keyed = plain.withColumn("doc", F.coalesce(F.col(key).cast("long"), F.lit(simhash.NO_ID))).withColumn("th", F.xxhash64(x))
    rows = _sketches(keyed.select("doc", "th", x))
    nodes = rows.groupBy("n", "s0", "s1", *_LANES).agg(F.min(F.struct("doc", "th")).alias("first"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("id"), "n", *_LANES, "first"))
    near = _candidates(nodes.where("n > 0"))  # those without words are one node
    groups = simhash.components(stored(near)).select(F.col("fp").alias("id"), "root")
    asked = groups.join(nodes.select("id", "first.doc", "first.th", *_LANES), "id")
    texts = keyed.select("doc", "th", F.coalesce(x, F.lit("")).alias("text")).join(asked, ["doc", "th"]).dropDuplicates(["root", "id"])
    texts = stored(texts.select("root", "id", "text", *_LANES))
    members = stored(_against_first(texts))
    links = members.where("copy and id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(_rest_links(members))
    copies = simhash.components(stored(links)).select(F.col("fp").alias("id"), "root")
    kept = nodes.join(copies, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select("first.doc", "first.th")
    held = stored(kept)
    forget(nodes, texts, members)
    return keyed.join(held, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select(*plain.columns).toDF(*names)
