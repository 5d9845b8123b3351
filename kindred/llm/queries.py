"""The operators of this package as queries over whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import (
    collocations,
    fingerprints,
    hard_negatives,
    language_id,
    language_model,
    licenses,
    mixing,
    neardup,
    pieces,
    quality_classifier,
    quality_rules,
    simhash,
    warc,
)
from kindred.llm.common import table


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op3_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.by_labels(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.from_embeddings(table(spark, folder, "embeddings"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_fingerprints": op2_fingerprints,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_language_model": op8_language_model,
    "op9_licenses": op9_licenses,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash": op13_simhash,
}

SQL: dict[str, str] = {
    "op2_fingerprints": fingerprints.sql(),
    "op6_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
        ), judged AS (
            SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM firsts
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first END AS refers_to
        FROM judged
    """,
    "op9_licenses": licenses.sql(),
    "op11_collocations": collocations.sql(),
    "op12_hard_negatives": hard_negatives.sql(),
}
