"""Grading of responses by question type: joins and aggregations on built-in functions.

Score = points * (right - wrong) / total, not below 0 where wrong parts count, to ten decimals; null where nothing was
answered or the type is graded by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.functions.text import trimmed


def score(right: Column, total: Column, points: Column, wrong: Column | None = None) -> Column:
    s = F.when(total > 0, right / total * points).otherwise(0.0)
    if wrong is not None:
        s = F.when((wrong > 0) & (total > 0), F.greatest(s - wrong / total * points, F.lit(0.0))).otherwise(s)
    return F.round(s, 10)


def grade_single(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """responses (student, item, chosen), keys (item, correct, points): right if chosen is the correct option."""
    joined = responses.join(keys, "item")
    return joined.where(F.col("chosen").isNotNull()).select("student", "item", score((F.col("chosen") == F.col("correct")).cast("int"), F.lit(1), F.col("points")).alias("score"))


def grade_choice(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """responses (student, item, chosen), keys (item, correct array, points): right if chosen is any correct option.

    Every response stays: nothing chosen, or an item without a key, gives null.
    """
    rows = responses.join(keys, "item", "left")
    right = F.array_contains("correct", F.col("chosen")).cast("int")
    return rows.select("student", "item", F.when(trimmed(F.coalesce("chosen", F.lit(""))) != "", score(right, F.lit(1), F.col("points"))).alias("score"))


def grade_multiple(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """responses (student, item, chosen array), keys (item, options array, correct array, points).

    Right parts are chosen correct options, wrong ones chosen other options of the item; unknown options are not counted and
    nothing chosen gives null.
    """
    chosen, correct = F.array_distinct("chosen"), F.array_distinct("correct")
    right = F.size(F.array_intersect(chosen, correct))
    wrong = F.size(F.array_intersect(chosen, F.array_except("options", correct)))
    graded = score(right, F.greatest(F.size(correct), F.lit(1)), F.col("points"), wrong)
    return responses.join(keys, "item").select("student", "item", F.when(F.size("chosen") > 0, graded).alias("score"))


def grade_short(responses: DataFrame, accepted: DataFrame) -> DataFrame:
    """responses (student, item, value), accepted (item, answer, points): right if any answer equals, outer blanks and case aside."""
    key = lambda c: F.lower(trimmed(c))
    answers = accepted.where(trimmed(F.col("answer")) != "").groupBy("item").agg(F.collect_set(key("answer")).alias("answers"), F.max("points").alias("points"))
    return responses.where(F.col("value").isNotNull()).join(answers, "item").select("student", "item", score(F.array_contains("answers", key(F.col("value"))).cast("int"), F.lit(1), F.col("points")).alias("score"))


def grade_numeric(responses: DataFrame, intervals: DataFrame) -> DataFrame:
    """responses (student, item, value text), intervals (item, low, high, points): right if in any closed interval.

    All commas go first, so 12,5 is 125; what is no number is 0; a blank answer scores 0.
    """
    raw = trimmed(F.replace("value", F.lit(","), F.lit("")))
    x = F.when(raw.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), raw.try_cast("double")).otherwise(0.0)
    spans = intervals.groupBy("item").agg(F.collect_list(F.struct("low", "high")).alias("spans"), F.max("points").alias("points"))
    rows = responses.where(F.col("value").isNotNull()).withColumn("x", x).join(spans, "item")
    hit = F.exists("spans", lambda s: (F.col("x") >= F.least(s["low"], s["high"]) - 1e-12) & (F.col("x") <= F.greatest(s["low"], s["high"]) + 1e-12))
    return rows.select("student", "item", score(((trimmed(F.col("value")) != "") & hit).cast("int"), F.lit(1), F.col("points")).alias("score"))


def grade_blanks(responses: DataFrame, keys: DataFrame, exact: bool = False) -> DataFrame:
    """responses (student, item, blank, value), keys (item, blank, accepted, points): the share of blanks that are right.

    A blank is right if any accepted text equals (case and outer blanks aside; exact: as it is, for option ids).  Blanks that
    nobody defined don't count; if all values are blank, the score is null.
    """
    key = (lambda c: c) if exact else (lambda c: F.lower(trimmed(c)))
    blanks = keys.groupBy("item", "blank").agg(F.collect_set(key(F.col("accepted"))).alias("accepted"))
    size = keys.groupBy("item").agg(F.countDistinct("blank").alias("total"), F.max("points").alias("points"))
    hit = F.coalesce(F.array_contains("accepted", key(F.col("value"))), F.lit(False))
    rows = responses.join(blanks, ["item", "blank"], "left").groupBy("student", "item").agg(F.sum(hit.cast("int")).alias("right"), F.max((trimmed(F.coalesce("value", F.lit(""))) != "").cast("int")).alias("answered"))
    return rows.join(size, "item").select("student", "item", F.when(F.col("answered") == 1, score(F.col("right"), F.col("total"), F.col("points"))).alias("score"))


def grade_matching(responses: DataFrame, pairs: DataFrame, rights: DataFrame) -> DataFrame:
    """responses (student, item, left_id, right_id), pairs (item, left_id, right, points), rights (item, right_id, right).

    A left is right if the chosen right side has the text of its pair, whichever of equal texts was chosen.
    """
    chosen = responses.where(F.col("right_id").isNotNull() & (F.col("right_id") != "")).join(rights.withColumnRenamed("right", "said"), ["item", "right_id"], "left")
    rows = chosen.join(pairs.select("item", "left_id", "right"), ["item", "left_id"], "left").groupBy("student", "item").agg(F.sum(F.coalesce((F.col("said") == F.col("right")).cast("int"), F.lit(0))).alias("hits"))
    size = pairs.groupBy("item").agg(F.count("*").alias("total"), F.max("points").alias("points"))
    everyone = responses.select("student", "item").distinct().join(rows, ["student", "item"], "left").join(size, "item")
    return everyone.select("student", "item", F.when(F.col("hits").isNotNull(), score(F.col("hits"), F.col("total"), F.col("points"))).alias("score"))


def totals(scores: DataFrame) -> DataFrame:
    """A row a student: graded items and their total."""
    return scores.groupBy("student").agg(F.count("score").alias("graded"), F.round(F.sum("score"), 6).alias("total"))


def grade_by_hand(responses: DataFrame) -> DataFrame:
    """Essays and texts: a row with a null score for each response, so that totals count them as ungraded."""
    return responses.select("student", "item", F.lit(None).cast("double").alias("score"))
