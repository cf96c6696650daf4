"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import url_filter

    return url_filter.judged(_read(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import suffix_dedup

    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import quality

    return quality.report(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import packing

    return packing.packed(_read(spark, sf_dir, "documents"), packing.Packing(public_tokenizers.path("byte_bpe_50k.json")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import token_files

    return token_files.report(_read(spark, sf_dir, "documents"), token_files.TokenFiles(public_tokenizers.path("word_bpe_49k.json")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import line_dedup

    return line_dedup.report(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import mixing

    return mixing.report(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import html_extract

    return html_extract.extracted(_read(spark, sf_dir, "pages"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import media

    return media.report(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import ngram_join

    return ngram_join.joined(_read(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import decontamination

    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import resampling

    return resampling.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import word_runs

    return word_runs.report(_read(spark, sf_dir, "documents"), word_runs.WordRuns(planted=True))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_suffix_dedup, op3_quality_rules, op4_packing, op5_token_files, op6_line_dedup, op7_mixing, op8_html_extraction, op9_media_columns, op10_ngram_join, op11_decontamination, op12_resampling, op13_word_runs, pipeline)}

_WORDS = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op11_decontamination": f"""
        WITH items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
        windows AS (
            SELECT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10) q
            UNION ALL SELECT item_id, w FROM items WHERE len(w) BETWEEN 1 AND 9),
        docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
        places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lengths WHERE len(w) >= n),
        hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM places) p JOIN windows USING (g)),
        covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) q GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) q GROUP BY doc_id)
        SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
