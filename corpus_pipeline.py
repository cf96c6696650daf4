"""The training-data pipeline: quality rules, line removal, near-duplicate documents, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``.

Defined results: null, empty and blank texts fail the quality rules; an empty table gives an empty result; repeated rows are judged row by row, lose
the lines that the first of them keeps, and stay together in the join, which knows documents by id; where lines or documents are equally good the least
``doc_id`` stays; extra columns stay as they are up to the mix and are not read by the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_dedup, mixing, ngram_join, packing, quality
from millrace.llm.tables import discard, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one stays."""
    return line_dedup.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays."""
    return ngram_join.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.sampled(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.packed(docs, packing.Packing(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality_rules), ("line dedup", fuzzy_lines), ("n-gram Jaccard join", near_duplicates), ("mixing", source_mix), ("packing", sequences)]

#: Near duplicates, fuzzy lines and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder, and goes when the next table is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
            discard(*before)
            before = [docs]
    return docs
