"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

STAGES are functions of (spark, docs, sf_dir). Each works on what its predecessor kept; all but the last
return the columns of `documents`. `run` writes every stage's rows as Parquet in the shared folder and
reads them for the next, so a lost executor costs no earlier stage.

The classifier learns from the labelled rows of `documents` in `sf_dir` (those outside its held-out
fold), not from the stage's input: the rules before it have removed most of the documents it has to know.

Null and empty texts fail the quality rules; repeated rows are near duplicates of each other; null ids,
languages and sources are handled as each operator says; extra columns pass through the first three
stages, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import classifier, neardup, packing, quality
from tidemark.llm.common import table
from tidemark.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts."""
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return neardup.deduplicated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # near duplicates and packing have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
