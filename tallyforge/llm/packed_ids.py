"""Token ids in patched frame-of-reference blocks.

A file is a run of segments, each followed by MARKER. All numbers are little-endian. A segment holds consecutive
documents in ascending id order:

    magic 'PFR1', n_docs u32, n_ids u32, n_blocks u32
    doc_id i64 [n_docs] (null: the least i64), n_tokens u32 [n_docs]
    block start u32 [n_blocks], from the end of this index
    blocks of BLOCK ids (the last may be shorter):
        minimum u32, width u8, n u16, n_exceptions u16
        the low `width` bits of each id less the minimum, packed, lowest bit first
        exception positions u16 [n_exceptions], their high bits u32 [n_exceptions]
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import definition_of, encoder
from .common import column, materialize, scratch
from .files import read_files, write_frames

BLOCK, PERCENTILE = 4096, 90
#: A segment ends with the document that brings its texts to this many bytes, and a file with this many segments, as files
#: are read whole: about 130 MB of text and less of ids, or one document more.
SEGMENT_BYTES, SEGMENTS_PER_FILE = 1 << 21, 64
MARKER = "\x1ePFR\x1e"
NULL_ID = -(2**63)


def _low_bits(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    wide = np.ascontiguousarray(values, "<u2" if width <= 16 else "<u4").view(np.uint8).reshape(len(values), -1)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little", count=width), bitorder="little").tobytes()


def pack(ids: np.ndarray) -> bytes:
    """One block."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    at = (len(rest) - 1) * PERCENTILE // 100
    width = int(np.partition(rest, at)[at]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    return struct.pack("<IBHH", low, width, len(ids), len(over)) + _low_bits(rest & np.uint32((1 << width) - 1), width) + over.astype("<u2").tobytes() + (rest[over] >> np.uint32(width)).astype("<u4").tobytes()


def unpack(data: bytes, at: int) -> np.ndarray:
    low, width, n, extra = struct.unpack_from("<IBHH", data, at)
    at += 9
    size = (n * width + 7) // 8
    rest = np.zeros(n, np.uint32)
    if width:
        room = 2 if width <= 16 else 4
        bits = np.zeros((n, 8 * room), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
        rest = np.packbits(bits, axis=1, bitorder="little").view(f"<u{room}")[:, 0].astype(np.uint32)
    at += size
    over = np.frombuffer(data, "<u2", extra, at)
    rest[over] |= np.frombuffer(data, "<u4", extra, at + 2 * extra).astype(np.uint32) << np.uint32(width)
    return rest + np.uint32(low)


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    start = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    head = b"PFR1" + struct.pack("<III", len(doc_ids), len(flat), len(blocks))
    table = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([len(i) // 4 for i in ids], "<u4").tobytes()
    return head + table + start.astype("<u4").tobytes() + b"".join(blocks)


class Segment:
    """A segment in a file's bytes; any document's ids are read from the blocks that hold them."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 4] != b"PFR1":
            raise ValueError("not a segment")
        n, self.n_ids, blocks = struct.unpack_from("<III", data, at + 4)
        at += 16
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.lengths = np.frombuffer(data, "<u4", n, at + 8 * n).astype(np.int64)
        self.index = np.frombuffer(data, "<u4", blocks, at + 12 * n).astype(np.int64)
        self.base, self.data = at + 12 * n + 4 * blocks, data
        self.starts = np.cumsum(self.lengths) - self.lengths

    def end(self) -> int:
        if not len(self.index):
            return self.base
        at = self.base + int(self.index[-1])
        _, width, n, extra = struct.unpack_from("<IBHH", self.data, at)
        return at + 9 + (n * width + 7) // 8 + 6 * extra

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of the segment."""
        hi = self.n_ids if hi is None else hi
        if hi <= lo:
            return np.empty(0, np.uint32)
        first = lo // BLOCK
        got = np.concatenate([unpack(self.data, self.base + int(self.index[b])) for b in range(first, (hi - 1) // BLOCK + 1)])
        return got[lo - first * BLOCK : hi - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i] + self.lengths[i]))


def segments(content: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(content):
        s = Segment(content, at)
        yield s
        at = s.end() + len(MARKER)


def _bounds(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that end with the one that brings them to `most`."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= most or i == len(sizes) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encodes docs and writes files in ascending doc_id order (a null id first, ties by a hash of the text).

    Texts are dealt out by id range and sorted, then encoded and packed in the task that writes them; a task begins a new
    file whenever one holds SEGMENTS_PER_FILE segments. shards: id ranges, the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(definition_of(tokenizer))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that repeat an id, or have none, are dealt out by their texts' hash.
    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*shared.value)
        for b in batches:
            for lo, hi in _bounds(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), SEGMENT_BYTES):
                part = b.slice(lo, hi - lo)
                ids = [i + end for i in enc.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([write_segment(part.column("doc_id").to_pylist(), ids)], pa.binary())], ["value"])

    write_frames(dealt.mapInArrow(run, "value binary"), path, MARKER, SEGMENTS_PER_FILE)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files at path; start counts the ids of all documents before.

    Each file is read once; what its documents hold is written as a table, whose sums by file, a row each, give every
    file's first start. Files are named in the order of their ranges, and within a range in the order of writing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                at = 0
                for s in segments(content.as_py()):
                    flat = s.ids().astype("<u4").tobytes()
                    bounds = np.append(s.starts, s.n_ids) * 4
                    crc = [zlib.crc32(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                    ids = [None if d == NULL_ID else d for d in s.doc_ids.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(s.starts + at), pa.array(s.lengths), pa.array(crc, pa.int64())], ["path", "doc_id", "local", "n_tokens", "ids_crc32"])
                    at += s.n_ids

    number = lambda p: F.coalesce(F.nullif(F.regexp_extract("path", p, 1), F.lit("")).cast("long"), F.lit(0))
    read = read_files(spark, path).mapInArrow(run, "path string, doc_id long, local long, n_tokens long, ids_crc32 long")
    rows = materialize(read.select(number(r"part-(\d+)").alias("range"), number(r"-c(\d+)").alias("file"), "doc_id", "local", "n_tokens", "ids_crc32"), "packed-rows")
    totals = rows.groupBy("range", "file").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("range", "file", (F.sum("total").over(Window.orderBy("range", "file")) - F.col("total")).alias("base"))
    return rows.join(base, ["range", "file"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def packed_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes docs' ids at path (a new folder in the shared one by default) and reads them back; see read_ids.

    A null text counts as empty; every document ends with end_id, so none is without ids. The strings of the tokenizer's
    added tokens are those tokens, as in the library. Repeated rows are written each; extra columns are ignored; an empty
    table gives no rows.
    """
    path = path or scratch(docs.sparkSession, "packed-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
