"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exalake.llm.decontaminate import decontaminate
from exalake.llm.line_dedup import dedup_lines
from exalake.llm.near_dedup import keep_one
from exalake.llm.sentencepiece_bpe import encode_decode
from exalake.llm.text_arrays import materialise
from exalake.llm.toxicity import reject_toxic

#: SQL can express neither the classifier nor the edit distances; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (fitted on labels) rejects go."""
    return reject_toxic(docs, _table(spark, sf_dir, "labels"), training_docs=_table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go; n_chars follows."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark go."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and whether decoding gives the text back."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_text=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
