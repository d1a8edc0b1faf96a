"""A training corpus from `documents`, in five stages; each takes all that its predecessor kept.

run() applies the stages to the table in a folder. Between stages the rows are written as Parquet to the shared folder; a
stage's folder goes when the next one is written, that of the last but one stage stays, since the result is read from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tamga.llm import bpe, exact_dedup, language_id, minhash_dedup, mixing
from tamga.llm._common import removed, shared_folder

#: Columns of `documents`, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a language, with the language that was found as `lang`. Profiles are learnt from the documents
    themselves; where none can be learnt, documents with a letter stay as they are."""
    names, prototypes = language_id.trained(docs)
    return language_id.known(docs, names, prototypes)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_exact(docs, keep="largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more link."""
    return minhash_dedup.drop_near(docs, words=5, percent=80)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates that bring the token shares of the domains to their targets, as few as possible left out; no document
    is repeated."""
    return mixing.mix(docs, mixing.labels_of(spark, sf_dir))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text back."""
    got = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary())
    return got.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("minhash_dedup", no_near_copies),
    ("mixing", mixed_to_weights),
    ("bpe", encoded),
]

#: Several stages go beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, written = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written.append(f"{folder}/{k}_{name}")
            docs.write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
            if k:
                removed(spark, written[-2])
    return docs
