"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next stage's documents.
All but the last return the columns of documents; the last tells how often the mix takes each document that is left.

Every stage reads whole texts of any length, gives an empty table for an empty one, keeps further columns under any name (the
last returns its own only), and takes nulls in any column as its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import materialize, table
from tidewell.llm.decontaminate import decontaminate
from tidewell.llm.line_dedup import dedup_lines
from tidewell.llm.mixing import mix
from tidewell.llm.quality import filter_quality
from tidewell.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep.

    Null and empty texts have too few words and go; equal rows are judged alike; without labels of both kinds only base rules apply.
    """
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the earliest of equal and near lines; documents left without words go.

    Null, empty and blank texts have no lines with words and stay; rows equal in doc_id and text are one document with equal results.
    """
    return dedup_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: SimHash links, and a share of 0.8 of five-word shingles.

    Null, empty and wordless texts are copies of each other; ids that are null or repeat don't matter, one row of a component stays.
    """
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items cut; documents that are mostly such spans go.

    Null and empty texts have no spans and stay; null and empty items match nothing, and an empty benchmark leaves all as they are.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size, target and copies of every document left.

    Null texts have no words and are taken by no copy; null sources form one source, the last.
    """
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the learned rules nor XXH64 fingerprints.
ORACLE_SQL: str | None = None
