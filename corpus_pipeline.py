"""From raw documents to packed training sequences, in stages that each read the one before.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet and
reads it again as the next one's documents, so that a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sentinela.llm import hamming_dedup, packing, quality, secrets, suffix_dedup
from sentinela.llm.common import ship, table, temporary_steps
from sentinela.sources.snapshots import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines are removed; documents that lose too much, or fail the base rules, go."""
    ship(spark)
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id stays."""
    ship(spark)
    return hamming_dedup.drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier in the corpus are cut out."""
    ship(spark)
    return suffix_dedup.drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    ship(spark)
    return secrets.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    ship(spark)
    pieces = packing.cut_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"),
        ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return packing.pack(pieces)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup), ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing)]

# Shingles, suffix windows and tokens have no SQL form; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``. A stage's own steps go once its documents are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        with temporary_steps(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
