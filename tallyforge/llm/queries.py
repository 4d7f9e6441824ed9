"""The operN queries over the corpus tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_trie, fingerprints, infill, langid, mixing, neardup, packed_ids, positive_unlabelled, repetition, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether labels of a row must not be learned; a row without doc_id is not held out, and nothing is learned from it."""
    at = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(at == remainder, F.lit(False)).alias("held_out")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_locally_consistent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame_bytes")


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op5_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0), "score", "predicted")


def op6_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs), "doc_id")
    return found.select("doc_id", "rule", F.col("start").cast("long"), F.length("match").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.packed_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.dictionaries(langid.learned_rows(docs)))
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score", "rejected")


def op11_permutation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_trie.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = positive_unlabelled.score(docs, positive_unlabelled.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(3, 1), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_locally_consistent_fingerprints": op2_locally_consistent_fingerprints,
    "op3_dictionary_warc": op3_dictionary_warc,
    "op4_repetition_coverage": op4_repetition_coverage,
    "op5_recurrent_toxicity": op5_recurrent_toxicity,
    "op6_forest_secrets": op6_forest_secrets,
    "op7_packed_token_ids": op7_packed_token_ids,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_compression_language": op10_compression_language,
    "op11_permutation_trie": op11_permutation_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_positive_unlabelled_quality": op13_positive_unlabelled_quality,
}

SQL: dict[str, str] = {
    "op1_pareto_mix": mixing.MIX_SQL,
    "op11_permutation_trie": filter_trie.AUDIT_SQL,
    "op12_fill_in_middle": infill.INFILL_SQL,
}
