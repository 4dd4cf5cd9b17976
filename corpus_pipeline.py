"""Corpus pipeline: five stages over ``documents``, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Odd rows have the results that
the operators define; in short: rows without text fail the quality rules, repeated rows of
one ``doc_id`` leave one row at the duplicate stage, and extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netbehave.llm import decontam, neardup, pieces, quality, secretscan
from netbehave.llm.words import stored, table

NEAR_PERCENT = 80  # least similarity of near duplicates; op7 has its own

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition rules."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secretscan.redact_secrets(docs, secretscan.fit(docs))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of each document, the text they decode to, and their sums."""
    known = pieces.read_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encoded(docs, known)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("piece encoding", piece_encoding),
]

# The fitted field of the secret scan and the piece lattice are beyond SQL;
# tests/llm/test_pipeline.py holds run() against plain versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
