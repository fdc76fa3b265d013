"""The bounded sample of labelled rows that a classifier is fitted on, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a classifier is fitted on; they are the first by a hash of their id.
SAMPLE_ROWS = 10_000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold.  Null ids, labels and texts aren't taken,
    nor ids whose labels contradict each other.

    The labels are cut to the bound before they meet the texts, so the broadcast side has at most `rows` narrow rows.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    agreed = known.where(fold("id", folds) != held).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    chosen = agreed.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "label")


def scored(frame: DataFrame, id_col: str, folds: int, held: int, threshold: float) -> DataFrame:
    """id, held_out, score, predicted from rows of (id, score)."""
    return frame.select(F.col("id").alias(id_col), (fold("id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
