"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a text into phrases of two to four symbols by what stands around a place alone; each
phrase is named by its content, and the names are parsed again, level upon level. Equal substrings therefore share
their inner phrase names wherever they stand. A fingerprint keeps the least names of the level that suits its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_chunks, column, mix64, powers

#: Names that a fingerprint keeps of a level, and the phrases a level must have to be the one compared.
NAMES, ENOUGH = 32, 24
LEVELS = 9


def _left(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    return out


def _runs(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one named symbol, so that neighbours in a text differ."""
    start = np.ones(len(sym), bool)
    start[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(sym))).astype(U64)
    return np.where(length > U64(1), mix64(sym[at] * U64(3) + (length << U64(32))), sym[at]), doc[at]


def _toss(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from its left neighbour, plus its own bit there."""
    diff = c ^ _left(c)
    diff[first] = 1
    bit = np.bitwise_count((diff & (~diff + c.dtype.type(1))) - c.dtype.type(1)).astype(c.dtype)
    return (bit << c.dtype.type(1)) | ((c >> bit) & c.dtype.type(1))


def landmarks(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the symbols that begin a phrase. sym: neighbours within a text differ; first: marks of text starts."""
    c = _toss(sym, first).astype(np.uint8)
    for _ in range(3):
        c = _toss(c, first)
    last = np.append(first[1:], True)
    for v in (5, 4, 3):  # no two neighbours hold v, so all of them choose anew at once
        at = np.flatnonzero(c == v)
        left = np.where(first[at], 9, c[at - 1])
        right = np.where(last[at], 9, c[np.minimum(at + 1, len(c) - 1)])
        c[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    left = np.where(first, -1, _left(c).astype(np.int8))
    right = np.where(last, -1, np.append(c[1:], c[-1:]).astype(np.int8))
    c = c.astype(np.int8)
    top = (c > left) & (c > right) & ~first
    near = top | np.append(False, top[:-1]) | np.append(top[1:], False)
    low = (c < left) & (c < right) & ~near & ~last
    mark = top | low
    mark &= ~np.append(False, first[:-1])  # a text's first phrase has two symbols at least
    return mark | first


def parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(name, text) of the phrases of each level, from level 1 up."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    sym = data.astype(U64) + U64(1)
    for level in range(1, LEVELS + 1):
        if not len(sym):
            yield sym, doc
            continue
        sym, doc = _runs(sym, doc)
        first = np.ones(len(sym), bool)
        first[1:] = doc[1:] != doc[:-1]
        start = np.flatnonzero(landmarks(sym, first))
        length = np.diff(np.append(start, len(sym)))
        pos = np.arange(len(sym)) - np.repeat(start, length)
        sym = mix64(np.add.reduceat(sym * powers(int(length.max()) + 1)[pos + 1], start) + length.astype(U64) * U64(level * 2 + 1))
        doc = doc[start]
        yield sym, doc


def fingerprints(texts: list[bytes]) -> list[str]:
    """'level:names/level below:names/1:names' of every text, names as 8 hex digits each in ascending order; '' for no text."""
    n = len(texts)
    top, parts = np.zeros(n, np.int64), [[] for _ in range(n)]
    data, offsets = byte_chunks(texts)
    kept = {}
    for level, (name, doc) in enumerate(parse(data, offsets), 1):
        kept[level] = (name, doc)
        count = np.bincount(doc, minlength=n)
        top[(count >= ENOUGH) | ((level == 1) & (count > 0))] = level
        if level > 1 and not (count >= ENOUGH).any():
            break
    for level, (name, doc) in kept.items():
        want = ((top == level) | (top == level + 1) | (level == 1))[doc]
        h, d = (name[want] >> U64(32)).astype(np.uint32), doc[want]
        if not len(h):
            continue
        key = np.unique((d.astype(U64) << U64(32)) | h)
        d, h = (key >> U64(32)).astype(np.int64), key.astype(np.uint32)
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        for i, lo, hi in zip(d[at], at, np.append(at[1:], len(d))):
            parts[i].append((level, h[lo : min(hi, lo + NAMES)].astype(">u4").tobytes().hex()))
    return ["/".join(f"{level}:{names}" for level, names in sorted(p, reverse=True)) for p in parts]


def likeness(x: str, y: str) -> float:
    """Estimated share of common phrases of two fingerprints, at the highest level that both hold."""
    if x == y:
        return 1.0
    a, b = (dict(p.split(":") for p in s.split("/") if p) for s in (x, y))
    common = a.keys() & b.keys()
    if min(max(map(int, a), default=1), max(map(int, b), default=1)) > 2:
        common -= {"1"}  # held for short and periodic texts alone
    if not common:
        return 0.0
    level = max(common, key=int)
    p, q = ({v[i : i + 8] for i in range(0, len(v), 8)} for v in (a[level], b[level]))
    least = sorted(p | q)[:NAMES]
    return sum(v in p and v in q for v in least) / len(least)


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many first ones of the following text, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The next document of a row is the one after it by doc_id (ties by text; a null doc_id comes first); after the last
    comes the first. Rows are dealt out in id ranges of about equal size and sorted within; the first row of a range
    also goes, marked, to the range before, so no row but these moves twice. A null text is empty; empty texts have
    the fingerprint '' and are alike. Repeated rows are neighbours; extra columns are ignored; an empty table gives no
    rows. A single row is its own next document.
    """
    spark = docs.sparkSession
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * tasks
    cuts = ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    place = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(place.value, key.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r[0], r[1]) for r in ids.select("key", range_of("key").alias("pid")).groupBy("pid").agg(F.min("key")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    known = spark.sparkContext.broadcast((np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)))

    @F.pandas_udf("array<int>")
    def dealt(key: pd.Series) -> pd.Series:
        k, (head, to) = key.to_numpy(), known.value
        own = np.searchsorted(place.value, k, side="right")
        at = np.minimum(np.searchsorted(head, k), max(len(head) - 1, 0))
        is_head = head[at] == k if len(head) else np.zeros(len(k), bool)
        return pd.Series([[int(o), int(to[a])] if s else [int(o)] for o, a, s in zip(own, at, is_head)], dtype=object)

    rows = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.withColumn("to", dealt("key")).select("doc_id", "text", "key", F.posexplode("to").alias("visits", "pid"))
    rows = rows.repartition(tasks, "pid").sortWithinPartitions("pid", "visits", "key", "text").select("doc_id", "text", "pid", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "pid", "visits"))):
                held.append(row)
                size += len(row[1])
                if size > 500_000:
                    yield _finish(held)
                    held, size = held[-1:], len(row[1])
        if held:
            yield _finish(held)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """Results of the rows that have their next one here; visiting rows only serve as next ones."""
    todo = [i for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][2] and not rows[i][3]]
    changed = [edited(rows[i][1], rows[i + 1][1]).encode() for i in todo]
    prints = fingerprints([r[1].encode() for r in rows])
    changed_prints = fingerprints(changed)
    cols = {
        "doc_id": pa.array([rows[i][0] for i in todo], pa.int64()),
        "n_chars": pa.array([len(rows[i][1]) for i in todo], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array([prints[i] for i in todo], pa.string()),
        "edited_fingerprint": pa.array(changed_prints, pa.string()),
        "near_edited": pa.array([likeness(prints[i], e) for i, e in zip(todo, changed_prints)], pa.float64()),
        "near_next": pa.array([likeness(prints[i], prints[i + 1]) for i in todo], pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
