"""From documents to packed training sequences: every stage works on all that the one before it kept.

quality rules -> n-gram Jaccard join (one document of each group stays) -> substring dedup -> secret scans -> packing
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import ngram_join, packing, quality, secrets, substring
from pointloom.llm._io import written

#: Whole copies are the next stage's matter: there one of them stays. So they count once for the line rule, which would
#: else reject all of them, and with them the only text that they hold.
RULES = quality.QualityConfig(collapse_copies=True)
#: Near duplicates: five words and a similarity of 0.8.
NEAR = ngram_join.JoinConfig(size=5, percent=80)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, RULES)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs, NEAR)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.deduplicated(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", _quality),
    ("n-gram Jaccard join", _near),
    ("substring dedup", _passages),
    ("secret scans", _secrets),
    ("packing", _pack),
]

#: Components, repeated passages and packing patterns are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
