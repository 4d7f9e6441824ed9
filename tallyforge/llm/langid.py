"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

#: Documents that make up a language's dictionary, at most, and its bytes, which they share alike. A text beyond its share
#: gives PIECES pieces from all over it. Driver, broadcast and workers hold this many bytes a language.
DOCS_PER_LANGUAGE, DICTIONARY_BYTES, PIECES = 48, 1 << 19, 8
#: Bits a byte by which the best language must beat the next; below it the text counts as rejected.
MARGIN = 0.05
LEVEL = 3


def folded(text: Column) -> Column:
    """Lower-case letters with single spaces between, a word said over and over once: the rest is noise here."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.regexp_replace(plain, r"(?<![^ ])(\p{L}+)(?: \1(?![^ ]))+", "$1")


def learned_rows(docs: DataFrame) -> DataFrame:
    """The rows whose language may be learned: lang known and crc32(doc_id as text) mod 3 not 1."""
    return docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def dictionaries(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """language -> raw dictionary content, about `most` bytes at most, from per_language texts by hash of doc_id (ties by hash of
    the text).

    The first scan ranks rows by hashes alone: each task keeps per_language rows a language. The second fetches those rows
    by id and hash, once each however often they repeat, and a group a language joins them; only finished dictionaries come
    to the driver. Null texts, those without a letter and rows without doc_id are passed over; a language without others has no dictionary.
    """
    lettered = labelled.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ranked = lettered.select("doc_id", "lang", "h").withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= per_language)
    chosen = {(r.lang, r.doc_id, r.h) for r in ranked.select("lang", "doc_id", "h").distinct().collect()}
    if not chosen:
        return {}
    share = max(1, most // per_language)
    step = F.floor(share * F.length("t") / F.octet_length("t") / PIECES).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(F.col("t"), (1 + i * F.floor(F.length("t") / PIECES)).cast("int"), step))
    picked = lettered.filter(F.col("doc_id").isin(list({c[1] for c in chosen})) & F.col("h").isin(list({c[2] for c in chosen})))
    picked = picked.select("lang", "doc_id", "h", folded(F.col("text")).alias("t")).groupBy("lang", "doc_id", "h").agg(F.first("t").alias("t"))
    picked = picked.withColumn("t", F.when(F.octet_length("t") <= share, F.col("t")).otherwise(F.array_join(pieces, " ")))
    wanted = labelled.sparkSession.createDataFrame(sorted(chosen), "lang string, doc_id long, h long")
    per = picked.join(wanted, ["lang", "doc_id", "h"], "left_semi").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h", "t"))).alias("texts"))
    joined = per.select("lang", F.array_join(F.transform("texts", lambda x: x["t"]), "\n").alias("content")).collect()
    return {r.lang: r.content.encode() for r in joined}


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, margin) of every row of docs.

    Each text's letters, in lower case, are compressed whole with every language's dictionary; the smallest wins, ties by language. score is the
    winner's share of exp(-bits a byte * 8) over the languages; rejected marks a winner that beats the next by less
    than margin bits a byte. A null text or one without a letter is 'und' with score 0 and rejected, and so is every
    text when no language was learned; a single language takes every text with a letter. Repeated rows are judged alike;
    texts of any length are compressed whole; extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sorted(content.items()))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    docs = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).select("doc_id", F.when(lettered, folded(F.col("text"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for lang, raw in shared.value:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tools.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                if text is None or not tools:
                    rows.append(("und", 0.0, True, 0.0))
                    continue
                raw = text.encode()
                bits = sorted((8 * len(c.compress(raw)) / len(raw), lang) for lang, c in tools)
                best = bits[0][0]
                lead = bits[1][0] - best if len(bits) > 1 else best
                rows.append((bits[0][1], 1 / sum(math.exp(-8 * (x - best)) for x, _ in bits), lead < margin, lead))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64())))], ["doc_id", "lang_pred", "score", "rejected", "margin"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, margin double")
