"""A training corpus from raw documents: language, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before has kept. ``run`` writes each stage to the
shared folder and reads it again, so a lost executor never reaches back beyond one stage. No SQL can express the models and the
tokenizer, so ``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm import decontaminate, language, packing, secrets, simhash
from pagestrata.llm.base import stage, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of a half or more."""
    return language.kept_languages(docs, language.fit(docs.filter(language.learnable())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced."""
    return secrets.redacted(docs, secrets.scan(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
