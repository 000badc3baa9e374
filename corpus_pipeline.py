"""From raw documents to a mixed, tokenised corpus: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkmetry.llm import boilerplate, minhash, mixing, pieces, quality
from talkmetry.llm.common import store, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def strip_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources are cut behind their first occurrence."""
    return boilerplate.strip_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", strip_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("piece ids", encode_pieces),
]

#: No SQL: the classifier, the cube method and the tokenizer have none. tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
