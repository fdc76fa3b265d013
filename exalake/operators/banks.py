"""Banks of questions: summaries, merging by title, points, what is exported, kinds of files, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.functions.text import collapse

#: A key file has so few real questions; a document with so many numbered items, nearly all without an answer, is suspicious.
FEW_QUESTIONS, MANY_ITEMS, NEARLY_ALL = 5, 5, 0.8


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    """(by, error, warn, info): how many issues of each level; other levels don't count."""
    return issues.groupBy(*by).agg(*[F.count_if(F.col("level") == level).alias(level) for level in ("error", "warn", "info")])


def _flagged(questions: DataFrame, issues: DataFrame, deselected: DataFrame) -> DataFrame:
    """questions with failed, warned and chosen; issues: (bank, pos, level), deselected: (bank, pos)."""
    found = issues.groupBy("bank", "pos").agg(F.bool_or(F.col("level") == "error").alias("failed"), F.bool_or(F.col("level") == "warn").alias("warned"))
    off = deselected.select("bank", "pos").distinct().withColumn("off", F.lit(True))
    rows = questions.join(found, ["bank", "pos"], "left").join(off, ["bank", "pos"], "left")
    no = F.lit(False)
    rows = rows.withColumn("failed", F.coalesce("failed", no)).withColumn("warned", F.coalesce("warned", no))
    return rows.withColumn("chosen", ~F.col("failed") & ~F.coalesce("off", no)).drop("off")


def bank_summary(questions: DataFrame, issues: DataFrame, deselected: DataFrame) -> DataFrame:
    """One row a bank: items, by_type, failed, warned, exportable, selected and the points of the selected."""
    rows = _flagged(questions, issues, deselected)
    kinds = rows.groupBy("bank", "type").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.count_if("warned").alias("warned"), F.count_if("chosen").alias("selected"),
        F.sum(F.when(F.col("chosen") & ~F.isnan("points"), F.col("points")).otherwise(0.0)).alias("points"),
    )
    by_type = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("type", F.lit("")), "n")))).alias("by_type")
    return kinds.groupBy("bank").agg(F.sum("n").alias("items"), by_type, F.sum("failed").alias("failed"), F.sum("warned").alias("warned"), (F.sum("n") - F.sum("failed")).alias("exportable"), F.sum("selected").alias("selected"), F.round(F.sum("points"), 4).alias("points"))


def banks_to_export(questions: DataFrame, issues: DataFrame, deselected: DataFrame) -> DataFrame:
    """(bank, pos, chosen) of the banks with a question to export; the others keep their place but aren't chosen."""
    rows = _flagged(questions, issues, deselected).select("bank", "pos", "chosen")
    return rows.join(rows.where("chosen").select("bank").distinct(), "bank", "left_semi")


def merge_titles(rows: DataFrame, title: str, order: str, ignore_case: bool = True) -> DataFrame:
    """rows with bank, the first spelling of their title (blanks collapsed; case aside unless it counts), and pos within it."""
    clean = collapse(F.coalesce(F.col(title), F.lit("")))
    keyed = rows.withColumn("_key", F.lower(clean) if ignore_case else clean)
    first = keyed.groupBy(F.col("_key").alias("_first")).agg(F.min_by(clean, order).alias("bank"))
    pos = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    return keyed.withColumn("pos", pos).join(first, F.col("_key") == F.col("_first")).drop("_key", "_first")


def group_points(items: DataFrame, by: list[str]) -> DataFrame:
    """items (by, kind, points, per, correct): a group of several right answers has per for each of them, others the sum of their items."""
    return items.groupBy(*by).agg(F.round(F.sum(F.when(F.col("kind") == "multi", F.col("per") * F.col("correct")).otherwise(F.coalesce("points", "per"))), 4).alias("points"), F.count_distinct(F.coalesce("points", "per")).alias("shares"))


def reading_mode(lines: DataFrame, by: str) -> DataFrame:
    """(by, mode): 'cau' where lines are named as questions, 'so' where they are only numbered.  lines: (by, named, numbered)."""
    named, numbered = F.count_if("named"), F.count_if(F.col("numbered") & ~F.col("named"))
    return lines.groupBy(by).agg(F.when((named >= 2) | ((named >= 1) & (numbered < 3)), "cau").otherwise("so").alias("mode"))


def mostly_unanswered(questions: DataFrame, modes: DataFrame, by: str) -> DataFrame:
    """(by, items, unanswered) of documents read by number that are nearly all essays without a solution."""
    counted = questions.groupBy(by).agg(F.count("*").alias("items"), F.count_if((F.col("type") == "essay") & (F.coalesce("feedback", F.lit("")) == "")).alias("unanswered"))
    return counted.where((F.col("items") >= MANY_ITEMS) & (F.col("unanswered") >= NEARLY_ALL * F.col("items"))).join(modes.where("mode = 'so'").select(by), by, "left_semi")


def is_key_file(s: Column, k: Column) -> Column:
    """Whether a document is an answer key: s (real, with_options, items, answered, named), k (count, from_table, likely, strict, titled).

    It has few real questions, and enough entries that look like answers, more than it has answered questions.
    """
    few = (s["real"] <= FEW_QUESTIONS) | (s["named"] & (s["with_options"] == 0))
    enough = (k["count"] >= 3) & (s["answered"] * 3 <= k["count"]) & ((k["from_table"] >= 3) | (k["likely"] >= 0.6 * k["count"])) & (k["strict"] >= 0.3 * k["count"])
    told = s["named"] | k["titled"] | (k["strict"] >= 0.7 * k["count"])
    return few & enough & told & ((s["real"] * 3 <= k["count"]) | (s["named"] & (s["with_options"] == 0) & (k["count"] >= s["items"])))


def question_numbers(lines: DataFrame, by: str, order: str) -> DataFrame:
    """lines (by, order, number, heading, complete) with starts: a number that opens a question.

    One not above the last opened is list text, but for 1 after a complete question.  A heading starts anew.
    """
    w = Window.partitionBy(by).orderBy(order)
    anew = F.coalesce("heading", F.lit(False)) | ((F.col("number") == 1) & F.coalesce("complete", F.lit(False)))
    part = lines.withColumn("_part", F.sum(anew.cast("int")).over(w))
    before = F.max("number").over(Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return part.withColumn("starts", F.col("number").isNotNull() & (before.isNull() | (F.col("number") > before) | (F.col("number") == 0))).drop("_part")


def innermost_ranges(questions: DataFrame, ranges: DataFrame, by: str, widest: int = 80) -> DataFrame:
    """questions (by, no) with group, the narrowest range (by, group, low, high) around no; of equal ones the later.

    A range is a row a number, so the join is one of equal keys; ranges over `widest` numbers are none.  These rows move to
    their numbers as they are: to sort them for a first choice where they are made takes memory for all of a task's ranges.
    """
    each = ranges.where((F.col("high") >= F.col("low")) & (F.col("high") - F.col("low") < widest)).select(by, "group", (F.col("high") - F.col("low")).alias("_size"), F.explode(F.sequence("low", "high")).alias("no"))
    best = each.repartition(by, "no").groupBy(by, "no").agg(F.min_by("group", F.struct("_size", -F.col("group"))).alias("group"))
    return questions.join(best, [by, "no"], "left")


def number_label(nos: Column) -> Column:
    """'3' for one number, 'a–b' for numbers on end, else 'a, b, c'."""
    on_end = F.forall(F.sequence(F.lit(1), F.size(nos) - 1), lambda i: F.get(nos, i) == F.get(nos, i - 1) + 1)
    text = F.transform(nos, lambda n: n.cast("string"))
    return F.when(F.size(nos) == 1, F.get(text, F.lit(0))).when(on_end, F.concat(F.get(text, F.lit(0)), F.lit("–"), F.element_at(text, -1))).otherwise(F.array_join(text, ", "))


def repeated_numbers(items: DataFrame, by: str) -> DataFrame:
    """(by, prefixed): whether a number comes in more than one part, so that identifiers need the part.  items: (by, part, no)."""
    numbers = items.groupBy(by, "no").agg((F.min("part") != F.max("part")).alias("twice"))
    return numbers.groupBy(by).agg(F.bool_or("twice").alias("prefixed"))


def answers_by_text(options: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    """(by, label) of answers (by, answer) that equal the text of exactly one option (by, label, text), blanks and case aside."""
    key = lambda c: F.lower(collapse(c))
    said = answers.select(*by, key(F.col("answer")).alias("_key"))
    met = options.select(*by, "label", key(F.col("text")).alias("_key")).join(said, [*by, "_key"])
    return met.groupBy(*by).agg(F.count("*").alias("_n"), F.min("label").alias("label")).where("_n = 1").drop("_n")


def split_statements(questions: DataFrame) -> DataFrame:
    """True and false questions (ident, points, statements) as an item a statement; the last takes the rest of the points."""
    each = questions.select("ident", "points", F.size("statements").alias("n"), F.posexplode("statements").alias("at", "s"))
    share = F.round(F.col("points") / F.col("n"), 4)
    rest = F.round(F.col("points") - share * (F.col("n") - 1), 4)
    last = F.col("at") == F.col("n") - 1
    return each.select(F.concat("ident", F.lit("_s"), (F.col("at") + 1).cast("string")).alias("ident"), F.when(last, rest).otherwise(share).alias("points"), F.col("s.html").alias("html"), F.col("s.value").alias("value"))


def box_prefix(content: Column, n: Column) -> Column:
    """The first of s, y, ds, tf, yds whose boxes [s1] ... [sn] don't stand in the content; yds if all do."""
    free = lambda p: ~F.exists(F.sequence(F.lit(1), n), lambda i: F.contains(content, F.concat(F.lit(f"[{p}"), i.cast("string"), F.lit("]"))))
    return F.coalesce(*[F.when(free(p), p) for p in ("s", "y", "ds", "tf", "yds")], F.lit("yds"))


def without_box_marks(passage: Column, ids: Column) -> Column:
    """The passage with a zero-width space in what reads as a box of the question."""
    return F.aggregate(ids, passage, lambda acc, i: F.replace(acc, F.concat(F.lit("["), i, F.lit("]")), F.concat(F.lit("[​"), i, F.lit("]"))))


def from_first_bank(lines: DataFrame, by: str, order: str) -> DataFrame:
    """lines (by, order, opens) from the first line that opens a bank on; all lines of a document without one."""
    first = lines.where("opens").groupBy(by).agg(F.min(order).alias("_first"))
    return lines.join(first, by, "left").where(F.col("_first").isNull() | (F.col(order) >= F.col("_first"))).drop("_first")


def marked_by_format(runs: DataFrame, by: str, option: str, least: float = 0.8) -> DataFrame:
    """(by, option, marked): options of which at least that share of the characters, blanks aside, is formatted; a format of all options marks none.

    runs: (by, option, text, formatted).  An option without text isn't marked.
    """
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    share = runs.groupBy(by, option).agg((F.sum(F.when(F.col("formatted"), size).otherwise(0)) >= least * F.sum(size)).alias("_own"), (F.sum(size) > 0).alias("_some"))
    share = share.select(by, option, (F.col("_own") & F.col("_some")).alias("marked"))
    every = share.groupBy(F.col(by).alias("_by")).agg(F.bool_and("marked").alias("_all"))
    return share.join(every, F.col(by).eqNullSafe(F.col("_by"))).select(by, option, (F.col("marked") & ~F.col("_all")).alias("marked"))
