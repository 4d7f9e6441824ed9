"""Repetition coverage: characters inside duplicated word n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, column, line_hashes, mix64, text_chunks

#: Largest share of a text's word characters that duplicated n-grams of each length may cover: the published limits, all
#: below the base rule's 20 % of words, so that they decide over texts that pass it.
NGRAM_LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share that lines equal to an earlier line may hold, likewise.
LINE_LIMIT = 0.20
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _repeated(w: Words, n: int) -> np.ndarray:
    """Marks the words in n-word windows that occur twice or more in their text, the first included."""
    marked = np.zeros(len(w.hash), bool)
    m = len(w.hash) - n + 1
    if m <= 0:
        return marked
    h = w.hash[:m].copy()
    for j in range(1, n):
        h = h * U64(0x9E3779B97F4A7C15) + w.hash[j : m + j]
    inside = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    key = mix64(h[inside] ^ mix64(w.doc[inside].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for j in range(n):
        marked[inside[twice] + j] = True
    return marked


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(equal-to-an-earlier-line counts of each text, mark of each word in such a line)."""
    n, docs = len(w.data), len(w.offsets) - 1
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    start = start[start < n]
    stop = np.append(start[1:], n)
    length = stop - start
    length = length - (w.data[stop - 1] == 10) if len(start) else length
    at = np.flatnonzero(length > 0)
    start, length = start[at], length[at]
    has_word = np.zeros(len(start), bool)
    line_of = np.searchsorted(start, w.start, side="right") - 1
    has_word[line_of] = True
    doc = np.searchsorted(w.offsets[1:], start, side="right")
    key = mix64(line_hashes(w.data, start, length) ^ mix64(doc.astype(U64) + U64(7)))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    later &= has_word
    return np.bincount(doc[later], minlength=docs), later[line_of]


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, offsets)
    docs = len(offsets) - 1
    point = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(point & w.inside, dtype=np.int64)])
    chars = total[w.start + w.length] - total[w.start]
    word_chars = np.bincount(w.doc, chars, docs).astype(np.int64)
    share = lambda mark: np.bincount(w.doc[mark], chars[mark], docs) / np.maximum(word_chars, 1)
    dup_lines, in_dup_line = _lines(w)
    out = {"n_words": w.count, "word_chars": word_chars, "n_symbols": w.per_doc(_SYMBOLS[data]), "n_dup_lines": dup_lines}
    marks = {n: _repeated(w, n) for n in NGRAM_LIMITS}
    out["n_repeat_words"] = np.bincount(w.doc[marks[5]], minlength=docs)
    out |= {f"dup_{n}_share": share(m) for n, m in marks.items()}
    return out | {"dup_line_share": share(in_dup_line)}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [*(f"dup_{n}_share" for n in NGRAM_LIMITS), "dup_line_share"]


def repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, shares, base_failed, kept) of every row of docs.

    Shares are characters in words of duplicated n-grams, or of lines equal to an earlier one, over all characters in
    words. base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed
    and every share within its limit. A null or empty text has no words and fails the base; repeated rows are judged
    alike; extra columns are ignored; an empty table gives no rows. Texts are taken whole, whatever their length.
    """
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                m = measures(data, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), *(pa.array(m[c].astype(np.float64)) for c in SHARES)], ["doc_id", *COUNTS, *SHARES])

    out = docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.col("dup_line_share") <= LINE_LIMIT
    for n, most in NGRAM_LIMITS.items():
        fine &= F.col(f"dup_{n}_share") <= most
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
