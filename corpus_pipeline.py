"""A corpus pipeline: toxic documents go, near-duplicate groups keep one, secrets are masked, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, mixing, neardup, secrets, toxicity
from tallyforge.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network, trained on the labels, predicts to be toxic.

    Rows are judged one by one, repeated ones alike; null and wordless texts stay; columns of any name come through; an
    empty table stays empty. Without labels of both classes: toxicity.train.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 5-word shingles at a similarity of 0.8.

    Texts that repeat a doc_id are documents of their own, of which exact repeats leave one; null and wordless texts stay
    all; columns of any name come through; an empty table stays empty. Texts are compared whole.
    """
    return neardup.without_near_duplicates(docs, shingle=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the forest confirms become [SECRET], and n_chars follows; no row goes, null and empty texts stay as they
    are, repeated rows change alike, and columns of any name come through."""
    return secrets.redact(docs, secrets.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so that sources come near their targets in words. Rows without words are taken
    like others of their source; a null source is one of its own; columns of any name come through."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: token count and digests of ids, decoded bytes and offsets. A null text has no tokens."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("byte BPE", encode),
]

#: A trained network and a tokenizer decide, which SQL cannot express; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
