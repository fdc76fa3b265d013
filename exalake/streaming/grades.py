"""Responses as a stream: graded against a static key as they come, summed in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESPONSES = "student long, item long, chosen long, at timestamp"


def read_responses(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of RESPONSES below folder, as they arrive."""
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_scores(responses: DataFrame, keys: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(student, start, graded, total) of each window of event time; responses later than `late` are left out.

    keys (item, correct, points) is static, so the join needs no state; a repeated response (same student, item and time)
    within the watermark counts once.
    """
    fresh = responses.withWatermark("at", late).dropDuplicatesWithinWatermark(["student", "item", "at"])
    graded = fresh.join(keys, "item").withColumn("score", F.when(F.col("chosen") == F.col("correct"), F.col("points")).otherwise(0.0))
    sums = graded.groupBy(F.window("at", window).alias("w"), "student").agg(F.count("*").alias("graded"), F.round(F.sum("score"), 6).alias("total"))
    return sums.select("student", F.col("w.start").alias("start"), "graded", "total")


def write_scores(scores: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Closed windows to Parquet, once each; runs until what is there now is read."""
    return scores.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
