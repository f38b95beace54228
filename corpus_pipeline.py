"""A corpus from documents to tokens: quality rules, near-duplicates, secrets, the mix, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, quality, secrets_scan, similar
from tessera.llm.queries import documents, vocabulary_path
from tessera.operators.checkpoints import delete, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a verified Jaccard similarity of 0.8 or more over five-word shingles.

    Candidates come from SimHash classes, and from minhashes what SimHash misses.
    """
    return similar.one_of_similar(docs, words_each=5, like=0.8, bits=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix at weights 1, 2, 3 takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the text decoded from them."""
    return bpe.encode_decode(docs, vocabulary_path("byte_bpe_50k.json"), keep=["doc_id", "source"], ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: SQL has neither the near-duplicate fingerprints' hash nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written as Parquet to the shared checkpoint folder and read again.

    What a stage read goes once it is written; what the last stage reads stays for the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read is not None:
            delete(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return STAGES[-1][1](spark, docs, sf_dir)
