"""A corpus from raw documents to a training mixture, in five stages, each written as Parquet and read again as the next one's documents.

toxicity: documents that the string-kernel machine, trained on all labelled rows, calls toxic go.
near_duplicates: of each group of documents whose five-word shingles agree by 0.8 or more, the one with the smallest id stays.
decontamination: documents with a passage of a benchmark item go.
secrets: secrets in the texts are replaced by a mark; every document stays.
mixture: sources are mixed to their target weights; documents that the mix takes at all stay, with how many copies it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import contamination, jaccard, mixing, secrets, toxicity
from ledgerlight.llm.common import discard, settle, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones. Null and empty texts stay; repeated rows share their fate; an empty table stays empty; columns of any name are kept."""
    ship(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest id, a null id last. Null and empty texts are one group; of repeated rows one stays; columns of any name are kept."""
    ship(spark)
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage. Null and short texts stay; rows with equal ids and texts share their fate; columns of any name are kept."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a mark in place of each secret and n_chars set anew where there is one. Null and empty texts stay as they are; no row goes."""
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with copies and taken. Null and empty texts have no words and go; equal rows are one with all their copies; a null source is one of its own."""
    ship(spark)
    return mixing.take(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]

#: The stages train machines and draw random numbers: SQL can't express them. tests/llm/test_pipeline.py checks each stage's effect instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Of the tables written on the way only the last one is left."""
    docs = before = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = settle(spark, lambda f=f, docs=docs: f(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return docs
