"""Token-id files of patched frame-of-reference blocks.

A file holds consecutive documents, in ascending id order:
  header   magic, version, block size, documents, ids, blocks
  documents  id (int64), whether it is known (uint8; 0: null) and number of ids (uint64) of each
  index    per block: where its bytes start (uint64), its minimum (uint32), width (uint8), number of exceptions (uint16)
  blocks   id - minimum in `width` bits each, packed into 64-bit words, then the exceptions' positions (uint16) and values (uint32)
The width is the bits of a percentile of a block's differences; larger ones are exceptions. Any block can be read by itself.
"""

from __future__ import annotations

import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, stored
from .tokens import encoder, slices

MAGIC, VERSION, BLOCK, PERCENTILE = b"PFOR", 2, 512, 90
SEGMENT_IDS = 4_000_000
HEADER = np.dtype([("magic", "S4"), ("version", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")])
INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 64-bit words."""
    groups = values.reshape(-1, 64).astype(np.uint64)
    words = np.zeros((len(groups), max(width, 1)), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[:, word] |= groups[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, i] >> np.uint64(64 - shift)
    return words[:, :width].reshape(len(values), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    groups = words.reshape(-1, width)
    out = np.empty((len(groups), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = groups[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (groups[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = v & mask
    return out.reshape(-1, BLOCK).astype(np.uint32)


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    table = padded.reshape(blocks, BLOCK)
    low = table.min(axis=1) if blocks else np.empty(0, np.uint32)
    diff = table - low[:, None]
    k = BLOCK * PERCENTILE // 100
    top = np.partition(diff, k, axis=1)[:, k] if blocks else np.empty(0, np.uint32)
    width = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.uint8)  # bits of the value
    over = diff >> width.astype(np.uint32)[:, None] > 0
    over &= width[:, None] < 32
    index = np.zeros(blocks, INDEX)
    index["low"], index["width"], index["exceptions"] = low, width, over.sum(axis=1)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = _packed(np.where(over[at], 0, diff[at]), w)
        for b, row in zip(at.tolist(), packed, strict=True):
            where = np.flatnonzero(over[b])
            bodies[b] = row.astype("<u8").tobytes() + where.astype("<u2").tobytes() + diff[b, where].astype("<u4").tobytes()
    index["start"] = np.cumsum([0, *map(len, bodies[:-1])])[:blocks]
    head = np.array([(MAGIC, VERSION, BLOCK, len(doc_ids), len(ids), blocks)], HEADER)
    docs = np.zeros(len(doc_ids), DOC)
    docs["id"], docs["known"], docs["n"] = [i or 0 for i in doc_ids], [i is not None for i in doc_ids], counts
    return b"".join([head.tobytes(), docs.tobytes(), index.tobytes(), *bodies])


def _decoded(index: np.ndarray, raw: bytes, at: int) -> np.ndarray:
    """The blocks of an index, a row each; their bytes begin at place at of raw."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    for w in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == w)
        if w:
            size = BLOCK * w // 8
            words = np.stack([np.frombuffer(raw, "<u8", size // 8, at + s) for s in index["start"][rows].tolist()])
            out[rows] = _unpacked(words, w)
    for b in np.flatnonzero(index["exceptions"]).tolist():
        n, s = int(index["exceptions"][b]), at + int(index["start"][b]) + BLOCK * int(index["width"][b]) // 8
        out[b, np.frombuffer(raw, "<u2", n, s)] = np.frombuffer(raw, "<u4", n, s + 2 * n)
    out += index["low"][:, None]
    return out


def read_ids(path: str, first: int, n: int) -> np.ndarray:
    """n ids of a file from place first on: the index tells where their blocks are, and only those are read."""
    files, name = _files(path)
    with files.open_input_file(name) as f:
        head = np.frombuffer(f.read(HEADER.itemsize), HEADER)
        n = max(0, min(n, int(head["ids"][0]) - first))
        if not n:
            return np.empty(0, np.uint32)
        at = HEADER.itemsize + DOC.itemsize * int(head["docs"][0])
        a, b = first // BLOCK, -(-(first + n) // BLOCK)
        f.seek(at + INDEX.itemsize * a)
        index = np.frombuffer(f.read(INDEX.itemsize * (b - a)), INDEX).copy()
        last = index[-1]
        low = int(index["start"][0])
        size = int(last["start"]) + BLOCK * int(last["width"]) // 8 + 6 * int(last["exceptions"]) - low
        f.seek(at + INDEX.itemsize * int(head["blocks"][0]) + low)
        index["start"] -= np.uint64(low)
        return _decoded(index, f.read(size), 0).ravel()[first - a * BLOCK :][:n]


def decode_file(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, ids) of a file."""
    head = np.frombuffer(raw, HEADER, 1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION or head["block"] != BLOCK:
        raise ValueError("not a token block file of this version")
    at = HEADER.itemsize
    docs = np.frombuffer(raw, DOC, int(head["docs"]), at)
    at += docs.nbytes
    index = np.frombuffer(raw, INDEX, int(head["blocks"]), at)
    at += index.nbytes
    return docs, _decoded(index, raw, at).ravel()[: int(head["ids"])]


def _files(uri: str):
    """A file system and a path for any URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else "file://" + uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """Encode each text, append end_id, write files in ascending id order; returns the files: path, part, segment, docs, ids, first_id.

    A file ends after SEGMENT_IDS ids, so memory holds one file's ids. Names come from the partition, and a file appears under its
    name only when it is whole: a task that runs again writes the same file.
    """

    def run(batches):
        enc = encoder(tokenizer, special)
        files, root = _files(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        end = int(end_id).to_bytes(4, "little")
        held: tuple[list, list, list] = ([], [], [])
        segment = total = 0

        def flush():
            nonlocal segment, total
            name = f"{root}/part-{part:06d}-{segment:05d}.pfor"
            data = encode_file(held[0], held[1], np.frombuffer(b"".join(held[2]), "<u4"))
            with files.open_output_stream(f"{name}.{attempt}.tmp") as f:
                f.write(data)
            files.move(f"{name}.{attempt}.tmp", name)
            row = [name], [part], [segment], [len(held[0])], [total], [held[0][0]]
            for x in held:
                x.clear()
            segment, total = segment + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "segment", "docs", "ids", "first_id"])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc, ids in zip(doc_ids[a:b], enc.encode([t or "" for t in texts[a:b]]), strict=True):
                    if total and total + len(ids) // 4 + 1 > SEGMENT_IDS:
                        yield flush()
                    held[0].append(doc)
                    held[1].append(len(ids) // 4 + 1)
                    held[2].append(ids + end)
                    total += held[1][-1]
        if total:
            yield flush()

    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "path string, part int, segment int, docs long, ids long, first_id long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files, decoded from them."""
    whole = files.groupBy("part").agg(F.sum("ids").alias("sum"))
    whole = whole.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("base"))  # a row a partition
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("ids")
    jobs = files.withColumn("inside", inside).join(whole, "part").select("path", (F.col("base") + F.col("inside")).alias("start"))

    def run(batches):
        store, _ = _files(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    docs, ids = decode_file(f.read())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(docs["n"].astype(np.int64))
                begins = ends - docs["n"].astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                known = pa.array(docs["id"].copy(), mask=docs["known"] == 0)
                yield pa.RecordBatch.from_arrays([known, pa.array(begins + start), pa.array(docs["n"].astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return jobs.repartition(partitions(files.sparkSession)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """Write the files below folder (default: a new shared one) and read them back: one row per document.

    With special, the strings of added tokens get their own ids. A null text is empty and has the end id alone. Null ids come
    first. Repeated rows are written as often as they are given, one behind the other. Other columns are not read. An empty table writes no file and gives an empty result.
    """
    folder = folder or shared_dir(docs.sparkSession)
    return read_token_files(stored(write_token_files(docs, folder, tokenizer, end_id, id_col, text, special)), folder)
