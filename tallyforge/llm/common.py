"""Helpers shared by the corpus operators: shared storage, Arrow text access, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder. Where neither is
    set, a local session gets a temporary folder; a cluster must name one, so there it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table. Those of an application lie together, under scratch-<application id>, so that
    one removal of that folder, once the application has ended, sweeps them all."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a task takes, about: a key with more is dealt over several parts.
PART = 256


def parts_of(n: Column) -> Column:
    """Over how many parts n rows of one key are dealt."""
    return F.ceil(n / PART)


def dealt_join(many: DataFrame, few: DataFrame, key: str, other: str, name: str = "dealt") -> DataFrame:
    """many join few on key; few has a row a key. Keys with more than PART rows of many are dealt over parts by `other`, and
    their rows of few are repeated once a part, so that no key lands in one task."""
    heavy = materialize(many.groupBy(key).agg(parts_of(F.count(F.lit(1))).alias("parts")).filter("parts > 1"), f"{name}-heavy")
    if not heavy.take(1):
        return many.join(few, key)
    left = many.join(heavy, key, "left").withColumn("part_", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
    right = few.join(heavy, key, "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")
    return left.join(right, [key, "part_"]).drop("part_")


def column(docs: DataFrame, name: str, kind: str):
    """docs[name], or a typed null where the table has no such column."""
    return docs[name] if name in docs.columns else F.lit(None).cast(kind).alias(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0xD6E8FEB86659FD93)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """_BASE ** i mod 2**64 for i < n."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, U64)
        p[0] = U64(1)
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


#: Values that one step of a loop over segments takes, about: what it holds beside its result stays small whatever the texts' size.
BLOCK = 1 << 18


def blocks(lengths: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive segments of about `most` values together, at least one segment each."""
    ends, i = np.cumsum(lengths), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def hash_segments(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of values[starts[i] : starts[i] + lengths[i]] for every i, or of what table has for them. All lengths are
    at least 1."""
    out = np.empty(len(starts), U64)
    power = powers(int(lengths.max())) if len(starts) else None
    for i, j in blocks(lengths):
        n = lengths[i:j]
        first = np.cumsum(n) - n
        pos = np.arange(int(n.sum())) - np.repeat(first, n)
        part = values[pos + np.repeat(starts[i:j], n)]
        out[i:j] = mix64(np.add.reduceat((part if table is None else table[part]) * power[pos], first) + n.astype(U64))
    return out


class Words:
    """The words of consecutive texts in one byte buffer.

    doc, start, length, hash: one entry for each word. offsets: byte bounds of the texts.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        self.inside = inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:n]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.hash = hash_segments(data, self.start, self.length, _BYTE[_LOWER] if lower else _BYTE) if hashed else None

    def per_doc(self, byte_mask: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        total = np.concatenate([[0], np.cumsum(byte_mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def line_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return hash_segments(data, starts, lengths, _BYTE)


def text_chunks(col: pa.Array, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about max_bytes at a time; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
