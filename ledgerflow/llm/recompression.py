"""Substring dedup by recompression: rounds name pairs and runs of symbols, so equal word runs get equal symbols inside.

Names are 128-bit hashes of what they stand for, so all tasks give a pair the same name without a table of names. A round's class
(left or right) of a symbol is a bit of its name; a left symbol followed by a right one becomes a pair. Whether two neighbours
join depends on them alone, so two equal word runs are parsed alike except for a few symbols at their ends.

Two kinds of symbols go to Spark:
* large ones, of LARGE words or more, and whole texts: where one also stands in a document with a smaller id, all its words are
  repeats;
* anchors, the smallest-named symbol of the third round inside each window of WINDOW words: windows that are equal have equal
  anchors. Windows with an anchor that a smaller document has, and not wholly within a large repeat, are compared by name: first
  all neighbouring windows of an anchor together; where those differ, the words before and behind the anchor tell which of the
  windows can be equal at all, and those are compared one by one.

All of these are only candidates: stretches of a text that should stand at some place of a document with a smaller id. The words of
that place are sent to the text, and what goes is what is the same there word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, forget, stored
from .tokens import slices

WINDOW, LARGE, ANCHOR_ROUND, MAX_ROUNDS = 50, 200, 3, 64
#: A third-round symbol has at most 8 words, so a window around one also holds this many words before it, or behind it.
AROUND = (WINDOW - 2**ANCHOR_ROUND) // 2
SLICE_CHARS = 1_500_000
NO_ID = 2**63 - 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_S = [np.uint64(x) for x in (27, 31, 33, 29)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LONG_WORD = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[1])) * _C[1]
    x ^= x >> _S[0]
    x *= _C[2]
    x ^= x >> _S[2]
    return x


def _join(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    return _mix(_mix(a + _C[lane]) + b * _C[3] + _C[4])


class Words:
    """Words of several texts: names in two lanes, first word of each text, and the bytes of any word."""

    def __init__(self, texts: list, bits: int = 64):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.raw = b"\n".join([*parts, b""]) + bytes(8)
        data = np.frombuffer(self.raw, np.uint8)
        word = ~_SPACE[data[:-8]]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        #: Index of each text's first word, and the number of all words at the end.
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        keep = np.uint64(2**bits - 1)  # fewer bits only in tests, which want different words with one name
        self.h = tuple(lane & keep for lane in self._names(data))

    def _names(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.ends - self.starts
        eight = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), shape=(len(data) - 7, 8), strides=(1, 1))
        lanes = [_mix(n.astype(np.uint64) * c + c) for c in (_C[0], _C[2])]
        live, at, left = np.arange(len(n)), self.starts.copy(), np.minimum(n, _LONG_WORD).copy()
        while len(live):
            block = np.ascontiguousarray(eight[at]).view("<u8").ravel()
            short = left < 8
            block = np.where(short, block & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), block)
            for lane, c in zip(lanes, (_C[3], _C[4]), strict=True):
                lane[live] = _mix((lane[live] ^ block) * c)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        if len(big := np.flatnonzero(n > _LONG_WORD)):
            import xxhash

            for i in big.tolist():
                digest = xxhash.xxh3_128_digest(self.raw[self.starts[i] : self.ends[i]])
                lanes[0][i], lanes[1][i] = np.frombuffer(digest, np.uint64)
        return lanes[0], lanes[1]

    def span_names(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the words from a to before b, of both lanes: differences of running sums, each word's name times a power."""
        out = []
        for lane, c in zip(self.h, (_C[1], _C[3]), strict=True):
            power = np.cumprod(np.full(len(lane) + 1, c))
            back = np.cumprod(np.full(len(lane) + 1, np.uint64(pow(int(c), -1, 2**64))))
            total = np.concatenate([[np.uint64(0)], np.cumsum(lane * power[:-1])])
            out.append(_mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * _C[4]))
        return out[0], out[1]

    def line(self, a: int, b: int) -> bytes:
        """The words from a to before b, joined by one space."""
        return b" ".join(self.raw[self.starts[a] : self.ends[b - 1]].split()) if b > a else b""

    def kept(self, text: int, gone: np.ndarray | None) -> str:
        """SHA-256 of the text's words that stay, joined by one space."""
        a, b = self.first[text], self.first[text + 1]
        keep = range(a, b) if gone is None else (np.flatnonzero(~gone) + a).tolist()
        starts, ends = self.starts, self.ends
        if gone is None or len(keep) == b - a:
            line = self.line(a, b)
        else:
            line = b" ".join([self.raw[starts[i] : ends[i]] for i in keep])
        return hashlib.sha256(line).hexdigest()


def _class(name: np.ndarray, turn: int) -> np.ndarray:
    """True: left. A bit of the name that changes with the round."""
    salt = np.uint64(int(_C[0]) * (turn + 1) % 2**64)
    return (_mix(name + salt) >> np.uint64(40)) & np.uint64(1) == 1


def parse(w: Words) -> tuple[tuple, tuple]:
    """(large symbols, anchors): (name, name, start, length) and (name, start, length, first window, last window), in word indices."""
    total = len(w.starts)
    opens = np.zeros(total + 1, bool)  # a text's first word: nothing joins across it
    opens[w.first] = True
    h1, h2 = w.h
    start = np.arange(total)
    lengths = np.diff(w.first)
    whole = np.repeat(w.first[1:], lengths)  # end of each word's text
    first = np.flatnonzero(start + WINDOW <= whole)  # windows, by their first word
    a, b = first.copy(), first + WINDOW - 1  # symbols certain to be parsed alike in each window
    large: list[tuple] = []

    def keep(at: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
        """LARGE words or more and a part below that (so no kept symbol covers it yet), or a whole text."""
        return (size >= LARGE) & (part < LARGE) | (size >= WINDOW) & opens[at] & opens[np.minimum(at + size, total)]

    anchors = (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4)
    for turn in range(MAX_ROUNDS):
        n = len(h1)
        if n < 2 or turn > ANCHOR_ROUND and n <= np.count_nonzero(lengths):
            break
        size = np.diff(start, append=total)
        if turn >= ANCHOR_ROUND:
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & ~opens[start[1:]]
            if same.any():
                head = np.flatnonzero(~np.concatenate([[False], same]))
                k = np.diff(head, append=n)
                unit = size[head]
                new1 = np.where(k > 1, _join(h1[head], k.astype(np.uint64), 3), h1[head])
                new2 = np.where(k > 1, _join(h2[head], k.astype(np.uint64), 4), h2[head])
                h1, h2, start = new1, new2, start[head]
                size = np.diff(start, append=total)
                made = (k > 1) & keep(start, size, unit)
                large.append((h1[made], h2[made], start[made], size[made]))
                n = len(h1)
                if n < 2:
                    break
        left = _class(h1, turn)
        pair = np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~opens[start[1:]]
        second = np.concatenate([[False], pair[:-1]])
        head = np.flatnonzero(~second)
        p = pair[head]
        one = np.flatnonzero(pair)
        new1, new2 = h1[head], h2[head]
        new1[p], new2[p] = _join(h1[one], h1[one + 1], 0), _join(h2[one], h2[one + 1], 2)
        if turn >= ANCHOR_ROUND:
            joined = size[one] + size[one + 1]
            made = keep(start[one], joined, np.minimum(size[one], size[one + 1]))
            large.append((new1[p][made], new2[p][made], start[one][made], joined[made]))
        if turn < ANCHOR_ROUND:
            # At its ends a window's symbols may join what stands outside: those are not certain any more.
            place = np.cumsum(~second) - 1
            a, b = a + ~left[a], b - left[b]
            a, b = place[np.minimum(a, n - 1)], place[b]
        h1, h2, start = new1, new2, start[head]
        if turn == ANCHOR_ROUND - 1 and len(first):
            anchors = _anchors(h1, start, total, first, a, b)
    empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*(large or [empty]), strict=True)), anchors


def _anchors(name: np.ndarray, start: np.ndarray, total: int, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """The smallest name from a to b of each window, long symbols first; windows in a row that share it are one entry."""
    size = np.diff(start, append=total)
    key = _mix(name + _C[4]) >> np.uint64(2)
    key |= ((size < 5).astype(np.uint64) + (size < 3).astype(np.uint64)) << np.uint64(62)
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int32)
    rank[order] = np.arange(len(key), dtype=np.int32)
    tables, step = [rank], 1
    longest = int((b - a).max()) + 1
    while 2 * step <= longest:
        t = tables[-1].copy()
        t[:-step] = np.minimum(t[:-step], t[step:])
        tables.append(t)
        step *= 2
    level = np.floor(np.log2(b - a + 1)).astype(np.int64)
    table = np.stack(tables)
    low = order[np.minimum(table[level, a], table[level, b - (1 << level) + 1])]
    cut = np.flatnonzero((low[1:] != low[:-1]) | (first[1:] != first[:-1] + 1)) + 1
    at, to = np.concatenate([[0], cut]), np.concatenate([cut, [len(first)]]) - 1
    own = low[at]
    return key[own], start[own], size[own], first[at], first[to]


def _owner(w: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, side="right") - 1


def _found(docs: DataFrame, bits: int) -> DataFrame:
    """Large symbols (kind 0): name, name2, doc, th and place (first, words).

    Anchors (kind 1): name, the name of all words of their windows (name2, name3), the names of the anchor with AROUND words before
    it (left) and behind it (right), doc, th and place: first window, further windows, and how many of them at the front hold all
    of left, at the back all of right.
    """

    def run(batches):
        names = ["kind", "name", "name2", "name3", "left", "right", "doc", "th", "place"]
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                w = Words(texts[lo:hi], bits)
                (n1, n2, at, size), (key, p, m, s, e) = parse(w)
                own = _owner(w, at)
                none = pa.nulls(len(at), pa.int64())
                columns = [pa.array(np.zeros(len(at), np.int32)), pa.array(n1.view(np.int64)), pa.array(n2.view(np.int64)), none, none, none, pa.array(doc[lo + own]), pa.array(th[lo + own]), pa.array((at - w.first[own]) << 32 | size)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                own = _owner(w, s)
                r1, r2 = w.span_names(s, e + WINDOW)
                left, _ = w.span_names(np.maximum(p - AROUND, w.first[own]), p + m)
                _, right = w.span_names(p, np.minimum(p + m + AROUND, w.first[own + 1]))
                front, back = np.maximum(p - AROUND + 1 - s, 0), np.maximum(e - (p + m + AROUND - 1 - WINDOW), 0)
                place = (s - w.first[own]) << 32 | (e - s) << 16 | np.minimum(front, 255) << 8 | np.minimum(back, 255)
                columns = [np.ones(len(s), np.int32), *[x.view(np.int64) for x in (key, r1, r2, left, right)], doc[lo + own], th[lo + own], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(run, "kind int, name long, name2 long, name3 long, left long, right long, doc long, th long, place long")


def _covered(n: int, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of n words the stretches cover."""
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, first, 1)
    np.add.at(turn, first + words, -1)
    return np.cumsum(turn[:-1]) > 0


def _windows(docs: DataFrame, bits: int) -> DataFrame:
    """Each window in the asked ranges of a text: doc, th, its first word, its name, and whether it has words outside the spans."""
    names = ["doc", "th", "at", "name", "name2", "open"]

    def run(batches):
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, spans, ranges = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for lo, hi in slices(texts, SLICE_CHARS):
                w = Words(texts[lo:hi], bits)
                found: list[tuple] = []
                for i in range(lo, hi):
                    base, n = int(w.first[i - lo]), int(w.first[i - lo + 1] - w.first[i - lo])
                    p = np.array(ranges[i], np.int64)
                    at = np.flatnonzero(_covered(n, p >> 32, (p & 0xFFFFFFFF) - (p >> 32) + 1))
                    at = at[at <= n - WINDOW]
                    # Windows that are wholly covered need no look, but later documents may have them from here.
                    p = np.array(spans[i] or [], np.int64)
                    left = np.concatenate([[0], np.cumsum(~_covered(n, p >> 32, p & 0xFFFFFFFF))])
                    found.append((np.full(len(at), doc[i]), np.full(len(at), th[i]), at, at + base, left[at + WINDOW] > left[at]))
                doc_, th_, at, where, open_ = (np.concatenate(x) for x in zip(*found, strict=True))
                n1, n2 = w.span_names(where, where + WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc_, th_, at, n1.view(np.int64), n2.view(np.int64), open_)], names=names)

    return docs.mapInArrow(run, "doc long, th long, at long, name long, name2 long, open boolean")


def _sources(docs: DataFrame) -> DataFrame:
    """from_doc, from_th, from_at, words and their compressed bytes, of the asked stretches of each text."""
    names = ["from_doc", "from_th", "from_at", "words", "source"]

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, th, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = Words([text])
                for x in asked:
                    a, n = x["from_at"], x["words"]
                    for column, v in zip(out, (doc, th, a, n, press.compress(w.line(a, a + n))), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=names)

    return docs.mapInArrow(run, "from_doc long, from_th long, from_at long, words long, source binary")


def _finished(docs: DataFrame) -> DataFrame:
    """What is left of each text (doc_id, text, candidates: at, words, source) once the stretches that are equal are gone."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, texts, candidates = (batch.column(i).to_pylist() for i in range(3))
            for lo, hi in slices(texts, SLICE_CHARS):
                w = Words(texts[lo:hi])
                out: list[list] = [[], [], [], []]
                for i in range(lo, hi):
                    base, n = int(w.first[i - lo]), int(w.first[i - lo + 1] - w.first[i - lo])
                    same = [(x["at"], x["words"]) for x in candidates[i] or () if w.line(base + x["at"], base + x["at"] + x["words"]) == open_.decompress(x["source"])]
                    gone = _covered(n, *np.array(same, np.int64).T) if same else None
                    for column, v in zip(out, (ids[i], n, 0 if gone is None else int(gone.sum()), w.kept(i - lo, gone)), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _merged(found: DataFrame) -> DataFrame:
    """Candidates (doc, th, at, words, source: doc, th, place) merged where they go on in one source, without those inside another."""
    f = found.select("doc", "th", "at", "words", F.col("low.doc").alias("from_doc"), F.col("low.th").alias("from_th"), (F.col("low.at") - F.col("at")).alias("shift"))
    line = Window.partitionBy("doc", "th", "from_doc", "from_th", "shift").orderBy("at", "words")
    reach = F.max(F.col("at") + F.col("words")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.groupBy("doc", "th", "from_doc", "from_th", "shift", "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("words")).alias("end"))
    inner = Window.partitionBy("doc", "th").orderBy("at", F.desc("end"), "from_doc", "from_th", "shift").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("before", F.max("end").over(inner)).where(F.col("before").isNull() | (F.col("end") > F.col("before")))
    return f.select("doc", "th", "at", (F.col("end") - F.col("at")).alias("words"), "from_doc", "from_th", (F.col("at") + F.col("shift")).alias("from_at"))


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: what is left of each text once repeats of documents with smaller ids are gone.

    A word goes if a window of WINDOW consecutive words covers it whose word sequence also starts in a document with a smaller id;
    windows are judged on the input. Null and empty texts have no words. A null id counts as the largest one, so its texts give
    nothing to others; rows with one id never remove words of each other. Repeated rows come back as often as they are given.
    Other columns are not read. An empty table gives an empty result. A task's memory grows with the longest text.
    Nothing goes because of names alone; were two different stretches of one name, one of them might stay that could go.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
        F.col(text).alias("text"),
    )
    found = stored(_found(base.select("doc", "th", "text"), name_bits))
    large, anchors = found.where("kind = 0").drop("kind", "name3", "left", "right"), found.where("kind = 1").drop("kind")
    key = ["doc", "th"]
    high32, low32 = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))

    def twice(df: DataFrame, *names: str, at=None) -> DataFrame:
        """The names that several documents have, with the first of their places: low."""
        low = F.min(F.struct("doc", "th", at.alias("at")) if at is not None else F.struct("doc")).alias("low")
        return df.groupBy(*names).agg(low, F.max("doc").alias("high")).where("low.doc < high").drop("high")

    spans = large.join(stored(twice(large, "name", "name2", at=high32("place"))), ["name", "name2"]).where("doc > low.doc")
    spans = stored(spans.select(*key, high32("place").alias("at"), low32("place").alias("words"), "low"))
    inner = spans.groupBy(*key).agg(F.collect_set(F.shiftleft("at", 32) + F.col("words")).alias("spans"))

    # Windows outside those, where another document has their anchor.
    # Stored, so that the join has exchanges of its own, whose large partitions Spark splits where one anchor is in very many rows.
    shared = stored(twice(anchors, "name"))
    near = anchors.join(shared, "name").select(*key, "place", "name", "name2", "name3", "left", "right", (F.col("doc") > F.col("low.doc")).alias("later"))
    bits = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit(0xFF))
    first, front, back = high32("place"), bits(8), bits(0)
    last = first + bits(16)
    at, words = (lambda s: F.shiftright(s, 32)), (lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF)))
    inside = F.exists("spans", lambda s: (at(s) <= first) & (at(s) + words(s) >= last + WINDOW))
    near = stored(near.join(inner, key, "left").where(~F.coalesce(inside, F.lit(False))).drop("spans"))
    forget(found)
    drop_shuffles(spark)
    # All windows of an anchor at once: a smaller document has the same words around the same anchor.
    tested = near.join(stored(twice(near, "name2", "name3", at=first)), ["name2", "name3"], "left").withColumn("again", F.coalesce(F.col("doc") > F.col("low.doc"), F.lit(False)))
    whole, near = near, stored(tested.select(*key, "place", "name", "left", "right", "later", "again", "low"))
    forget(whole)
    more = near.where("again").select(*key, first.alias("at"), (last + WINDOW - first).alias("words"), "low")
    # Windows that hold the words before (behind) an anchor go where no other document has those.
    rest = near.where("not again")
    around = stored(twice(rest.select("doc", F.explode(F.array("left", "right")).alias("side")), "side").drop("low"))
    rest = rest.join(around.select(F.col("side").alias("left"), F.lit(0).alias("skip")), "left", "left")
    rest = rest.join(around.select(F.col("side").alias("right"), F.lit(0).alias("stop")), "right", "left")
    begin, end = first + F.coalesce("skip", front), last - F.coalesce("stop", back)
    rest = rest.select(*key, "name", "later", begin.alias("begin"), end.alias("end")).where("begin <= end")
    rest = stored(rest.select(*key, "name", "later", (F.shiftleft("begin", 32) + F.col("end")).alias("place")))
    # The others one by one, where a document with a larger id asks for their anchor.
    asked = stored(rest.where("later").select("name").distinct())
    ranges = rest.join(asked, "name", "left_semi").groupBy(*key).agg(F.collect_set("place").alias("ranges"))
    known = stored(spans.select(*key, "at", "words").unionByName(more.select(*key, "at", "words")).groupBy(*key).agg(F.collect_set(F.shiftleft("at", 32) + F.col("words")).alias("spans")))
    texts = base.select("doc", "th", "text").join(ranges.hint("merge"), key).join(known.hint("merge"), key, "left").dropDuplicates(key)
    windows = stored(_windows(texts.select("doc", "th", "text", "spans", "ranges"), name_bits))
    forget(rest, known)
    single = windows.join(stored(twice(windows, "name", "name2", at=F.col("at"))), ["name", "name2"]).where("open and doc > low.doc")
    single = single.select(*key, "at", F.lit(WINDOW).cast("long").alias("words"), "low")

    # The words of the first places travel to the candidates and are compared there.
    candidates = stored(_merged(spans.unionByName(more).unionByName(single)))
    forget(windows, near)
    drop_shuffles(spark)
    asked = candidates.groupBy(F.col("from_doc").alias("doc"), F.col("from_th").alias("th")).agg(F.collect_set(F.struct("from_at", "words")).alias("asked"))
    texts = base.select("doc", "th", "text").join(asked.hint("merge"), key).dropDuplicates(key)
    sources = stored(_sources(texts.select("doc", "th", "text", "asked")))
    drop_shuffles(spark)
    held = candidates.join(sources.hint("merge"), ["from_doc", "from_th", "from_at", "words"])
    held = stored(held.groupBy(*key).agg(F.collect_list(F.struct("at", "words", "source")).alias("candidates")))
    forget(sources, candidates)
    drop_shuffles(spark)
    return _finished(base.join(held.hint("merge"), key, "left").select("doc_id", "text", "candidates"))
