"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts.

A tile holds fingerprints with the same population counts of their parts. Two tiles whose counts differ by more than the radius in
sum can hold no link, so their pair is skipped; all other pairs are compared exactly. A tile is cut into blocks, and blocks, not
single fingerprints, travel to the tiles that they are compared with. What is left is quadratic: doubling the fingerprints doubles
the blocks that each one meets. Finer tiles for larger tables keep the factor small (see _parts); results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .tokens import slices

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a block at most, and fingerprints that come to one task to meet a block.
BLOCK_ROWS, VISITORS = 65_536, 262_144
_STRIP = (32, 8192)
NO_ID = 2**63 - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def majority_bits(sets: list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """A row of lanes 64-bit SimHashes for each set of hashes (none empty): a bit is set if it is in over half of them.

    Further lanes mix the hashes anew.
    """
    h, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    bounds = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), lanes), np.uint64)
    for lane in range(lanes):
        if lane:
            h = (h ^ (h >> np.uint64(29))) * _MIX[lane - 1]
            h ^= h >> np.uint64(32)
        votes = np.empty((len(sets), 64), np.int64)
        for k in range(8):  # a byte of each hash at a time: the bits of all hashes at once take 64 bytes a hash
            bits = np.unpackbits((h >> np.uint64(8 * k)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            votes[:, 8 * k : 8 * k + 8] = np.add.reduceat(bits, bounds, axis=0, dtype=np.int32)
        out[:, lane] = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_batch(texts: list, shingle: int = SHINGLE, lanes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, shingles): a row of lanes 64-bit SimHashes for each text, and how many shingles it has.

    Words of the text with A-Z lowered, XXH64 of the runs of shingle words (all words where there are fewer), repeats included.
    """
    import xxhash

    xx = xxhash.xxh64_intdigest
    out, count = np.zeros((len(texts), lanes), np.uint64), np.zeros(len(texts), np.int64)
    for a, b in slices(texts, 600_000 // lanes):
        parts, owners = [], []
        for i in range(a, b):
            words = (texts[i] or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                continue
            line = b" ".join(words)
            if len(words) < shingle:
                found = [xx(line, SEED)]
            else:
                stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = [0, *stop[: len(words) - shingle].tolist()]
                found = [xx(line[s:e], SEED) for s, e in zip(starts, (stop[shingle - 1 :] - 1).tolist(), strict=True)]
            parts.append(np.array(found, np.uint64))
            owners.append(i)
        if parts:
            count[owners] = [len(x) for x in parts]
            out[owners] = majority_bits(parts, lanes)
    return out, count


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fp, _ = fingerprint_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp[:, 0].view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, fp long")


def _steps(parts: int, width: int, radius: int, banded: bool) -> list[tuple[int, ...]]:
    """Differences of tiles that may hold links, one of each pair (d, -d) and the zero step; the first number is that of the bands.

    Counts are rounded down to multiples of width, so a difference of d steps means one of at least (d - 1) * width + 1 bits.
    """
    found: list[tuple[tuple[int, ...], int]] = [((), 0)]
    for _ in range(parts):
        grown = []
        for step, used in found:
            d = 0
            while (least := (d - 1) * width + 1 if d else 0) + used <= radius:
                grown += [((*step, x), used + least) for x in {d, -d}]
                d += 1
        found = grown
    zero = (0,) * (parts + 1)
    return sorted(x for step, _ in found for band in ((-1, 0, 1) if banded else (0,)) if (x := (band, *step)) >= zero)


def _parts(rows: int) -> int:
    """Into how many equal parts fingerprints are cut for their counts: finer tiles skip more pairs, but there are more of them."""
    return 2 if rows < 2_000_000 else 4 if rows < 20_000_000 else 8


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the given ones join, one at most per value: each value and the smallest of its group."""
    values, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(values))
    return values[child], values[label[child]]


def _compare(fp: np.ndarray, home: np.ndarray, radius: int, check=None, sizes: np.ndarray | None = None, ratio: float = 0) -> np.ndarray:
    """A label for each fingerprint, equal where links join them: links of one at home with any other, exactly.

    With sizes (ascending), a link's smaller size is at least ratio times the larger, so others are not looked at.
    """
    label = np.arange(len(fp))
    mine, others = np.flatnonzero(home), np.flatnonzero(~home)
    high, wide = _STRIP
    for other in (mine, others):
        for i in range(0, len(mine), high):
            rows = mine[i : i + high]
            low, end = (0, len(other)) if sizes is None else np.searchsorted(sizes[other], [sizes[rows[0]] * ratio - 0.5, sizes[rows[-1]] / ratio + 0.5])
            for j in range(max(i, low) if other is mine else low, end, wide):
                columns = other[j : min(j + wide, end)]
                r, c = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[columns][None, :]) <= radius)
                r, c = rows[r], columns[c]
                new = label[r] != label[c]  # what is joined already needs no look, so large groups cost no more
                r, c = r[new], c[new]
                if check is not None and len(r):
                    new = check(r, c)
                    r, c = r[new], c[new]
                if len(r):
                    child, top = _forest(label[r], label[c])
                    renamed = np.arange(len(fp))
                    renamed[child] = top
                    label = renamed[label]
    return label


def near_links(nodes: DataFrame, radius: int = RADIUS, parts: int | None = None, width: int = 1, banded: bool = False, also: tuple[str, ...] = (), check=None) -> DataFrame:
    """Links (a, b) that join all nodes (id, fp; distinct) whose fingerprints differ in at most radius bits, thinned to few a node.

    banded: nodes have a column band, and only bands at most one apart are compared. check(columns) with the columns named in also
    gives a function of two index arrays that says which of such pairs are links indeed.
    """
    nodes = nodes.select("id", "fp", *(["band"] if banded else []), *also)
    parts = parts or _parts(nodes.count())
    bits = 64 // parts
    base = bits // width + 1
    digit = lambda i: F.floor(F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))) / width)
    tile: Column = sum((digit(i) * base**i for i in range(parts)), (F.col("band") if banded else F.lit(0)) * base**parts)
    held = stored(nodes.withColumn("tile", tile.cast("long")))
    sizes = stored(held.groupBy("tile").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    cells = held.join(sizes.select("tile", "blocks"), "tile").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = stored(cells.groupBy("tile", "block").agg(F.collect_list(F.struct("id", "fp", *also)).alias("rows")))
    # Which tile meets which. A tile's number is linear in its counts, so a step adds a fixed number; each count must stay in range.
    moves = [F.struct(F.lit(sum(d * base**i for i, d in enumerate([*step[1:], step[0]]))).cast("long").alias("add"), F.array(*map(F.lit, step[1:])).alias("d")) for step in _steps(parts, width, radius, banded)]
    counts = F.array(*[F.floor(F.col("tile") / base**i).cast("int") % base for i in range(parts)])
    pairs = sizes.select("tile", "blocks", "n", counts.alias("q"), F.explode(F.array(*moves)).alias("m"))
    pairs = pairs.where(F.forall(F.zip_with("q", "m.d", lambda x, y: x + y), lambda x: (x >= 0) & (x < base)))
    pairs = pairs.select("tile", "blocks", "n", (F.col("tile") + F.col("m.add")).alias("to")).join(sizes.select(F.col("tile").alias("to"), F.col("blocks").alias("to_blocks")), "to")
    shares = pairs.groupBy("to").agg(F.greatest(F.ceil(F.sum("n") / VISITORS), F.lit(1)).cast("int").alias("shares"))
    # A row for each block and each home that it goes to; at home it goes to every share.
    routes = pairs.join(shares, "to").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1)))
    own = F.col("tile") == F.col("to")
    routes = routes.where(~own | (F.col("block") <= F.col("at"))).withColumn("home", own & (F.col("block") == F.col("at")))
    one = F.array(F.pmod(F.xxhash64("tile", "block"), F.col("shares")).cast("int"))
    routes = routes.withColumn("share", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(one)))
    meetings = routes.select("tile", "block", "to", "at", "share", "home").join(blocks, ["tile", "block"])

    def run(group: pa.Table) -> pa.Table:
        lists = group.column("rows").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat = lists.flatten()
        get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        home = np.repeat(group.column("home").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
        ids = get("id")
        label = _compare(get("fp").view(np.uint64), home, radius, check and check({n: get(n) for n in also}))
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids[child], "b": ids[label[child]]})

    links = stored(meetings.groupBy("to", "at", "share").applyInArrow(run, "a long, b long").distinct())
    forget(held, sizes, blocks)
    return links


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for all values in links (a, b): root is the smallest value of its component.

    Each round takes the smallest root next to a value and then the root's own root; rounds end when nothing changes.
    """
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(roots.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("m"))
        hooked = stored(roots.join(near, "fp").select("fp", F.least("root", "m").alias("root"), F.col("root").alias("was")))
        # What a value's root has found belongs to all values of that root.
        best = hooked.groupBy(F.col("was").alias("fp")).agg(F.min("root").alias("best"))
        up = stored(hooked.join(best, "fp", "left").select("fp", F.least("root", F.coalesce("best", "root")).alias("root"), "was"))
        over = up.select(F.col("fp").alias("root"), F.col("root").alias("top"))
        new = stored(up.join(over, "root").select("fp", F.col("top").alias("root"), "was"))
        forget(roots, hooked, up)
        if new.where("root <> was").isEmpty():
            forget(both)
            return new.select("fp", "root")
        roots = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) for every row of docs.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Repeated rows come back
    as often as they are given. A null id stays null and is never a component's id unless the component has no other.
    Other columns of docs are not read. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    named = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
