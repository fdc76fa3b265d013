"""Answer keys: gathering, pairing with exams, joining with fallbacks, and what becomes of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.functions.answers import looks_like_key
from exalake.functions.text import comparison_key, trimmed

#: Words of file names that only say "answer key" (fixed values).
KEY_PHRASES = [["hdc"], ["huong", "dan", "cham"], ["hd", "cham"], ["dap", "an"], ["dapan"], ["da"], ["key"], ["answer", "key"], ["answers"], ["answer"], ["loi", "giai"]]
#: Words too common in file names to tell exams apart (fixed values).
COMMON_WORDS = ["de", "thi", "kiem", "tra", "bai", "chua", "cau", "hoi", "file", "ban", "va"]


def gather(entries: DataFrame) -> DataFrame:
    """entries (file, part, no, value, ord) to one row per (file, part, no): the first value, how many, whether they differ."""
    real = entries.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return real.groupBy("file", "part", "no").agg(F.min_by("value", "ord").alias("value"), F.count("*").alias("entries"), (F.countDistinct("value") > 1).alias("conflicting"))


def statistics(key: DataFrame) -> DataFrame:
    """Per file: answers, parts, those that look like answers, loosely and strictly."""
    return key.groupBy("file").agg(F.count("*").alias("answers"), F.countDistinct("part").alias("parts"), F.count_if(looks_like_key(F.col("value"))).alias("like_key"), F.count_if(looks_like_key(F.col("value"), strict=True)).alias("strict_key"))


def find_answers(questions: DataFrame, key: DataFrame) -> DataFrame:
    """questions (exam, qid, part, no), key (exam, part, no, value): the value for each question, null if none.

    If the key has the question's part, only that part counts; else the part without a name; else the only part.  The key is
    joined once, on candidate parts with their priority.
    """
    parts = key.groupBy("exam").agg(F.collect_set("part").alias("parts"))
    own = (F.col("part") != "") & F.array_contains("parts", F.col("part"))
    only = F.when(F.size("parts") == 1, F.col("parts")[0])
    tries = F.when(own, F.array(F.col("part"))).otherwise(F.array_distinct(F.array_compact(F.array(F.lit(""), only))))
    asked = questions.join(parts, "exam").select("exam", "qid", "no", F.posexplode(tries).alias("priority", "part"))
    hits = asked.join(key.select("exam", "part", "no", "value"), ["exam", "part", "no"])
    best = hits.groupBy("exam", "qid").agg(F.min_by("value", "priority").alias("value"), F.min_by("part", "priority").alias("key_part"))
    return questions.join(best, ["exam", "qid"], "left")


def nth_to_nth(questions: DataFrame, key: DataFrame) -> DataFrame:
    """The k-th key entry of (exam, no) to the k-th question with that number; null if there are fewer."""
    rank = lambda d: d.withColumn("nth", F.row_number().over(Window.partitionBy("exam", "no").orderBy("ord")))
    return rank(questions).join(rank(key).select("exam", "no", "nth", "value"), ["exam", "no", "nth"], "left")


def find_range_answers(questions: DataFrame, key: DataFrame) -> DataFrame:
    """questions (exam, qid, part, low, high), key (exam, part, no text, value): find_answers for a range of numbers.

    The values of all its numbers joined by ', '; if any number has none, the value that the key has for 'low-high'.  Questions
    of one exam and part over one range have one answer: it is looked up once, however many they are.
    """
    span = F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string"))
    numbers = F.transform(F.sequence("low", "high"), lambda n: n.cast("string"))
    asked = questions.select("exam", "part", "low", "high").distinct().select("exam", "part", F.struct("part", "low", "high").alias("asked"), F.explode(F.array_append(numbers, span)).alias("no"))
    found = find_answers(asked.withColumn("qid", F.struct("asked", "no")), key).where("value is not null")
    single = ~F.contains("no", F.lit("-"))
    values = F.sort_array(F.collect_list(F.when(single, F.struct(F.col("no").cast("int").alias("n"), "value"))))
    got = found.groupBy(F.col("exam").alias("_exam"), "asked").agg(values.alias("v"), F.max(F.when(~single, F.col("value"))).alias("whole"))
    joined = F.array_join(F.transform("v", lambda x: x["value"]), ", ")
    wide = F.col("asked.high") - F.col("asked.low") + 1
    got = got.select("_exam", F.col("asked.part").alias("_part"), F.col("asked.low").alias("_low"), F.col("asked.high").alias("_high"), F.when(F.size("v") == wide, joined).otherwise(F.col("whole")).alias("value"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("exam", "part", "low", "high")]
    return questions.join(got, on, "left").drop("_exam", "_part", "_low", "_high")


def unused_after(key: DataFrame, answered: DataFrame) -> DataFrame:
    """Key entries that no question took, also not by a fallback; answered is what find_answers gives (exam, no, key_part)."""
    taken = answered.where(F.col("key_part").isNotNull()).select("exam", F.col("key_part").alias("part"), "no").distinct()
    return key.join(taken, ["exam", "part", "no"], "left_anti")


def unused(key: DataFrame, questions: DataFrame) -> DataFrame:
    """Key entries that no question has."""
    return key.join(questions, ["exam", "part", "no"], "left_anti")


def outcome(marked: Column, keyed: Column) -> Column:
    """filled, same, conflict or skipped: the document's own answer always stays."""
    return F.when(F.coalesce(trimmed(keyed), F.lit("")) == "", "skipped").when(F.coalesce(trimmed(marked), F.lit("")) == "", "filled").when(comparison_key(marked) == comparison_key(keyed), "same").otherwise("conflict")


def base_name_tokens(tokens: Column) -> Column:
    """Tokens of a folded file name without answer-key words."""
    text = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    for phrase in sorted(KEY_PHRASES, key=len, reverse=True):
        text = F.regexp_replace(text, " " + "  ".join(phrase) + " ", "")
    return F.filter(F.split(F.trim(F.regexp_replace(text, " +", " ")), " "), lambda t: t != "")


def pair_names(keys: DataFrame, exams: DataFrame) -> DataFrame:
    """keys (key_id, tokens), exams (exam_id, tokens): the exam of each key by name, or null.

    The only exam with the same tokens; else the exam with the largest overlap (common tokens over the smaller set) if that
    is at least 0.8, one common token has a letter and two characters, and no other exam has as much.  Equal token sets are
    one: only distinct sets that share a token are paired, with the number of their exams and the least exam id.
    """
    plain = lambda c: F.array_sort(F.array_except(F.array_distinct(c), F.array(*[F.lit(w) for w in COMMON_WORDS])))
    joined = lambda d: d.withColumn("_t", F.array_join("tokens", "."))
    same = joined(exams).where("_t != ''").groupBy("_t").agg(F.count("*").alias("n"), F.min("exam_id").alias("exact"))
    k = joined(keys).select("key_id", "_t", plain("tokens").alias("a"))
    e = exams.groupBy(plain("tokens").alias("b")).agg(F.count("*").alias("exams"), F.min("exam_id").alias("least"))
    spread = k.select("a").distinct().select("a", F.explode("a").alias("t"))
    shared = spread.join(e.select("b", "exams", "least", F.explode("b").alias("t")), "t")
    telling = (F.length("t") >= 2) & F.col("t").rlike("[a-z]")
    overlap = F.count("*") / F.least(F.size("a"), F.size("b"))
    scored = shared.groupBy("a", "b").agg(overlap.alias("overlap"), F.max(telling).alias("telling"), F.first("exams").alias("exams"), F.first("least").alias("least")).where("telling")
    best = scored.groupBy("a").agg(F.max("overlap").alias("best"))
    top = scored.join(best, "a").where(F.col("overlap") == F.col("best")).groupBy("a").agg(F.sum("exams").alias("ties"), F.min("least").alias("likely"), F.max("best").alias("best"))
    out = k.join(same, "_t", "left").join(top, "a", "left")
    by_overlap = F.when((F.col("best") >= 0.8) & (F.col("ties") == 1), F.col("likely"))
    return out.select("key_id", F.when(F.col("n").isNull(), by_overlap).when(F.col("n") == 1, F.col("exact")).alias("exam_id"))
