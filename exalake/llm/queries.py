"""Queries of the numbered operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.line_dedup import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.decontaminate import contaminations

    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.pii import digest_columns, personal_data

    return digest_columns(personal_data(read(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.warc import archive_round_trip, new_folder

    return archive_round_trip(read(spark, sf_dir, "pages"), new_folder(spark)).drop("uri", "digest_ok")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.sentencepiece_bpe import round_trip_digests

    return round_trip_digests(read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.fingerprints import edit_fingerprints

    return edit_fingerprints(read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.centroids import clusters

    return clusters(read(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.phrases import phrases

    return phrases(read(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from exalake.llm.secrets import digest_columns, secrets, trained

    docs = read(spark, sf_dir, "documents")
    return digest_columns(secrets(docs, trained(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from exalake.llm.centroids import clusters_sql

    from exalake.llm.phrases import PHRASES_SQL
    from exalake.llm.secrets import SECRETS_SQL

    return {"op8_warc": OP8_SQL, "op11_centroids": clusters_sql(), "op12_phrases": PHRASES_SQL, "op13_secrets": SECRETS_SQL}


#: The written and read record of each page, without writing it.  DuckDB has sha1 but no base32: five bits at a time.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex, n) AS keeper FROM d),
b AS (SELECT *, list_transform(range(0, 32), lambda i: (
  (instr('0123456789abcdef', hex[CAST(i * 5 // 4 AS INTEGER) + 1]) - 1) * 16
  + coalesce(instr('0123456789abcdef', nullif(hex[CAST(i * 5 // 4 AS INTEGER) + 2], '')) - 1, 0)) // CAST(power(2, 3 - i * 5 % 4) AS INTEGER) % 32) AS fives FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(fives, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(v AS INTEGER) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b
"""
