"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage is one of the operators of ``recallspark.llm`` with production parameters, works on all that
the one before kept, and returns the columns of ``documents``; the last returns token ids' digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recallspark.llm import bpe, mixing, quality, simhash, substrings
from recallspark.session import cleared, deleted, new_folder, packed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return packed(quality.filtered(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return packed(simhash.thinned(docs, similarity=0.8, shingle=5))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out."""
    return packed(substrings.without_repeats(docs, 50))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' weights takes them."""
    return packed(mixing.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as digests, and the digest of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: Near copies by fingerprints and merges of byte pairs are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage makes for itself go once its result is written, and so do earlier results."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage-{number}")
        with cleared(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
            schema = made.schema
        docs = spark.read.schema(schema).parquet(path)
        if before is not None:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
