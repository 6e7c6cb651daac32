"""Line dedup by content-defined chunks: a rolling hash over line hashes chooses boundaries that move along with the text.

Chunks of several lines that stand elsewhere too carry long repeats whole. A repeat that holds no whole chunk, and what a repeat has
beyond its chunks, is met by windows of two lines. Either is compared, byte by byte, with its first place before its lines go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: A boundary follows a line where the hash of the last ROLL lines is 0 modulo EVERY.
ROLL, EVERY, MIN_LINES = 2, 4, 2
NO_ID = 2**63 - 1
_M, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def chunks_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    roll = np.zeros(len(h), np.uint64)
    for k in range(min(ROLL, len(h))):  # the last ROLL lines, each with its own power
        roll[k:] += h[: len(h) - k] * np.uint64(pow(int(_M), k + 1, 2**64))
    roll = (roll ^ (roll >> np.uint64(29))) * _K
    ends = np.flatnonzero((roll >> np.uint64(32)) % np.uint64(EVERY) == 0) + 1
    cuts = [0, *ends.tolist(), len(h)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _lines(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def units_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of over MIN_LINES lines, and of each window of MIN_LINES that is not blank alone."""
    windows = [(a, MIN_LINES) for a in range(len(lines) - MIN_LINES + 1) if any(x.strip() for x in lines[a : a + MIN_LINES])]
    return [c for c in chunks_of(lines) if c[1] > MIN_LINES] + windows


def _names(docs: DataFrame) -> DataFrame:
    """h1, h2, doc, th, place (first line, lines) of each unit."""
    import xxhash

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, th, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = _lines(text or "")
                for a, n in units_of(lines):
                    for column, v in zip(out, (xxhash.xxh3_128_digest(b"\n".join(lines[a : a + n])), doc, th, a << 32 | n), strict=True):
                        column.append(v)
            name = np.frombuffer(b"".join(out[0]), "<i8").reshape(-1, 2)
            columns = [pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1])), *[pa.array(c, pa.int64()) for c in out[1:]]]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "th", "place"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, th long, place long")


def _bytes(docs: DataFrame) -> DataFrame:
    """h1, h2 and the compressed lines of the asked units."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor()
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = _lines(text or "")
                for x in asked:
                    a, n = x["place"] >> 32, x["place"] & 0xFFFFFFFF
                    for column, v in zip(out, (x["h1"], x["h2"], press.compress(b"\n".join(lines[a : a + n]))), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h1", "h2", "first_bytes"])

    return docs.mapInArrow(run, "h1 long, h2 long, first_bytes binary")


def _repeats(names: DataFrame) -> DataFrame:
    """h1, h2, doc, th, place and first (doc, place, th) of the units that stand elsewhere before, without windows within such a chunk."""
    where = F.struct("doc", "place", "th")
    again = stored(names.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").drop("last"))
    # A merge join at every size, with exchanges of its own on both sides, so that Spark can split a unit that is in very many rows.
    found = names.join(again.hint("merge"), ["h1", "h2"]).where(where != F.col("first"))
    found = found.withColumns({"_from": F.shiftright("place", 32), "_n": F.col("place").bitwiseAND(0xFFFFFFFF)})
    # Chunks do not overlap, so the farthest end of those before tells whether a window lies within one.
    before = Window.partitionBy("doc", "th").orderBy("_from", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_n") > MIN_LINES, F.col("_from") + F.col("_n"))).over(before)
    found = found.withColumn("_reach", F.coalesce(reach, F.lit(0)))
    return found.where((F.col("_n") > MIN_LINES) | (F.col("_reach") < F.col("_from") + F.col("_n"))).drop("_from", "_n", "_reach")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated runs of lines taken out of the text, and n_lines (before) and n_removed_lines added.

    All lines of runs of two or more that stand before go: in a smaller id, or earlier in the same text. Of equal units the one with
    the smallest id and line stays. Rows whose id and text are both equal count as one document: they stay alike. A null text stays
    null and has no lines; a null id counts as the largest. Single lines are never removed alone, nor two blank lines that are no
    part of a chunk. Columns of docs named like the added ones are replaced, all others stay. An empty table gives an empty result.
    A line that goes equals one of a smaller id, or an earlier one of its own text, so each content stays once.
    """
    plain, names = numbered(docs)
    key, x = (f"c{names.index(c)}" for c in (id_col, text))
    keyed = plain.withColumn("doc", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).withColumn("th", F.xxhash64(x))
    found = stored(_repeats(stored(_names(keyed.select("doc", "th", x)))))
    asked = found.groupBy("first.doc", "first.th").agg(F.collect_set(F.struct("first.place", "h1", "h2")).alias("asked"))
    # Documents meet their units by a merge join at every size; a broadcast of what is found would depend on the corpus.
    firsts = keyed.select("doc", "th", x).join(asked.hint("merge"), ["doc", "th"]).select(x, "asked")
    held = stored(_bytes(firsts).dropDuplicates(["h1", "h2"]))
    drop = found.select("h1", "h2", "doc", "th", "place").join(held.hint("merge"), ["h1", "h2"])
    drop = drop.groupBy("doc", "th").agg(F.collect_set(F.struct("place", "first_bytes")).alias("drop"))
    joined = keyed.join(drop.hint("merge"), ["doc", "th"], "left").select(*plain.columns, "drop")
    schema = joined.drop("drop").schema.add("n_lines", "long").add("n_removed_lines", "long")
    at, out_names = names.index(text), [*plain.columns, "n_lines", "n_removed_lines"]
    width = len(names)

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], []]
            for value, drops in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                lines = _lines(value) if value is not None else []
                gone = set()
                for d in drops or ():
                    a, n = d["place"] >> 32, d["place"] & 0xFFFFFFFF
                    if b"\n".join(lines[a : a + n]) == open_.decompress(d["first_bytes"]):
                        gone.update(range(a, a + n))
                kept = value if not gone else b"\n".join([line for i, line in enumerate(lines) if i not in gone]).decode("utf-8", "surrogatepass")
                for column, v in zip(out, (kept, len(lines), len(gone)), strict=True):
                    column.append(v)
            columns = [*batch.columns[:width], pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
            columns[at] = pa.array(out[0], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    done = joined.mapInArrow(run, schema)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in ("n_lines", "n_removed_lines")]
    return done.select(*own, "n_lines", "n_removed_lines")
