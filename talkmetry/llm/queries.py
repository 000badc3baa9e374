"""The registered queries of this subpackage, each over its whole table, and their check SQL."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkmetry.llm import boilerplate, codes, collocations, knn, minhash, mixing, pieces, quality, rules, secrets, simhash, suffixes, templates
from talkmetry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.line_report(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_pages(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_report(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(table(spark, sf_dir, "embeddings"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_repeated_bytes, op2_near_duplicates, op3_line_dedup, op4_source_mix, op5_secret_spans, op6_quality_score,
    op7_main_text, op8_quality_rules, op9_piece_ids, op10_top_k, op11_vector_codes, op12_simhash_groups, op13_collocations, pipeline,
)}

ORACLES: dict[str, str] = {
    "op3_line_dedup": boilerplate.oracle(),
    "op10_top_k": knn.oracle(),
    "op11_vector_codes": codes.oracle(),
    "op13_collocations": collocations.oracle(),
}
