"""Queries of the problems on text (p4, p7, p8, p9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orelode.llm import credentials, language, packing, tokenizer
from orelode.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = credentials.credentials(table(spark, d, "documents"), table(spark, d, "fx_object"), table(spark, d, "scan_report"))
    return found.select("source_table", "record_id", "byte_offset").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "documents"), table(spark, d, "fx_object"), table(spark, d, "scan_report"))


def p4_redacted_reports(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_reports(table(spark, d, "scan_report"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts, read back from their ids."""
    return tokenizer.texts_of(tokenizer.token_ids(table(spark, d, "documents")))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_class"))


def p8_container_use(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_use(p8_packing(spark, d), table(spark, d, "container_class"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of containers: texts placed, pieces that do not follow on, containers beyond their class or with a smaller one that would do."""
    return packing.faults(p8_packing(spark, d), table(spark, d, "container_class"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_cases(language.language_segments(table(spark, d, "documents"), table(spark, d, "lang_sample")))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(table(spark, d, "documents"), table(spark, d, "lang_sample"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"), table(spark, d, "lang_sample"))


_QUERIES = [p4_found, p4_redacted, p4_redacted_reports, p7_ids, p7_texts, p8_packing, p8_container_use, p8_faults, p9_found, p9_segments, p9_documents]


SQL = {
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_faults": "SELECT count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_too_large FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
