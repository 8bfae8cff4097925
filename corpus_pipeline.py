"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is written as Parquet and read again as the next one's documents, so every pass of a
stage sees the same rows; the scratch tables it read are dropped then. All but the last return the
columns of ``documents``. Null texts, empty tables, repeated rows and extra columns are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm import decontaminate, exact, nearcopies, packing, quality
from cleanframe.llm.columns import free_name
from cleanframe.llm.queries import tokenizer_path
from cleanframe.session import drop_table, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    score, belief = free_name(docs, "quality_score"), free_name(docs, "weak_label")
    kept = quality.scored(docs, quality.fit(docs), into=score, belief=belief)
    return kept.where(F.col(score) >= 0.5).drop(score, belief)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact.keep_first(docs, stored=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return nearcopies.keep_one(docs, stored=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = free_name(docs, "overlaps")
    return decontaminate.overlaps(docs, benchmark, into=found).where(F.size(found) == 0).drop(found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express a trained scorer, a tokenizer or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        docs = write_table(out, name)
        if k:  # the first reads the documents themselves
            drop_table(out)
    return STAGES[-1][1](spark, docs, sf_dir)
