"""Validation of questions: a table of rules, each one boolean expression, to issue rows with stable codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.functions.text import collapse, has_tag, is_blank_html, occurrences, trimmed

QUESTION_TYPES = ["mc", "ma", "tf", "short", "num", "blanks", "dropdowns", "matching", "essay", "text"]
LONGEST_STEM = 15_000
BLANK_ID = "^[a-z][a-z0-9_]{0,15}$"

#: The union of all question types; columns that a type does not use are null.
QUESTION = """bank string, pos int, id string, no string, title string, type string, points double, stimulus string, stem string, feedback string,
choices array<struct<id:string,html:string,correct:boolean>>, statements array<struct<key:string,html:string,value:boolean>>, answers array<string>,
numeric struct<exact:double,margin:double,min:double,max:double>, blanks array<struct<id:string,accepts:array<string>>>,
dropdowns array<struct<id:string,options:array<string>,correct:int>>, pairs array<struct<left:string,right:string>>, distractors array<string>"""


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _n(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _twice(c: Column) -> Column:
    return _n(c) > _n(F.array_distinct(c))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def rules() -> list[tuple[str, str, Column]]:
    """(code, level, condition under which the issue is raised).  Types are checked first: the others assume a known one."""
    t, stem, stim = F.col("type"), _text("stem"), _text("stimulus")
    known = t.isin(QUESTION_TYPES)
    is_ = lambda *names: t.isin(*names)
    some = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    empty = lambda x: trimmed(_text(x)) == ""
    correct = _n(F.filter("choices", lambda c: F.coalesce(c["correct"], F.lit(False))))
    num = F.col("numeric")
    exact, span = num["exact"].isNotNull(), num["min"].isNotNull() | num["max"].isNotNull()
    ids = {"blanks": F.transform("blanks", lambda b: _text(b["id"])), "dropdowns": F.transform("dropdowns", lambda b: _text(b["id"]))}
    out = [
        ("id", "error", ~_text("id").rlike("^[a-z0-9_]+$")),
        ("type", "error", ~F.coalesce(known, F.lit(False))),
        ("points", "error", F.when(is_("text"), F.col("points").isNotNull() & ~(_finite(F.col("points")) & (F.col("points") >= 0))).otherwise(known & ~(_finite(F.col("points")) & (F.col("points") > 0)))),
        ("empty", "warn", known & is_blank_html(stem) & is_blank_html(stim) & ~(is_("tf") & (_n(F.col("statements")) > 0))),
        ("stem_long", "warn", known & (F.length(stem) > LONGEST_STEM)),
        ("with_stimulus_long", "warn", known & (F.length(stem) <= LONGEST_STEM) & (F.length(stem) + F.length(stim) > LONGEST_STEM)),
        ("choices_few", "error", is_("mc", "ma") & (_n(F.col("choices")) < 2)),
        ("choice_none_correct", "error", is_("mc", "ma") & (correct == 0)),
        ("choice_many_correct", "error", is_("mc") & (correct > 1)),
        ("choice_label_twice", "error", is_("mc", "ma") & _twice(F.transform("choices", lambda c, i: F.coalesce(c["id"], (i + 1).cast("string"))))),
        ("choice_empty", "warn", is_("mc", "ma") & some("choices", lambda c: c.isNotNull() & is_blank_html(c["html"]))),
        ("statements_none", "error", is_("tf") & (_n(F.col("statements")) < 1)),
        ("statement_undecided", "error", is_("tf") & some("statements", lambda s: s["value"].isNull())),
        ("statement_key_twice", "error", is_("tf") & _twice(F.transform("statements", lambda s, i: F.coalesce(s["key"], (i + 1).cast("string"))))),
        ("statement_empty", "warn", is_("tf") & some("statements", lambda s: is_blank_html(s["html"]))),
        ("short_none", "error", is_("short") & ~some("answers", lambda a: ~empty(a))),
        ("short_html", "error", is_("short") & some("answers", lambda a: has_tag(_text(a)))),
        ("num_missing", "error", is_("num") & (num.isNull() | (~exact & ~span))),
        ("num_margin", "error", is_("num") & exact & num["margin"].isNotNull() & ~(_finite(num["margin"]) & (num["margin"] >= 0))),
        ("num_exact", "error", is_("num") & exact & ~_finite(num["exact"])),
        ("num_range", "error", is_("num") & ~exact & span & ~(_finite(num["min"]) & _finite(num["max"]))),
        ("num_range_reversed", "error", is_("num") & ~exact & (num["min"] > num["max"])),
        ("pairs_few", "error", is_("matching") & (_n(F.col("pairs")) < 2)),
        ("pair_left_empty", "error", is_("matching") & some("pairs", lambda p: is_blank_html(p["left"]))),
        ("pair_right_empty", "error", is_("matching") & some("pairs", lambda p: empty(p["right"]))),
        ("pair_right_html", "error", is_("matching") & some("pairs", lambda p: has_tag(_text(p["right"])))),
        ("distractor_empty", "warn", is_("matching") & some("distractors", empty)),
        ("distractor_html", "error", is_("matching") & some("distractors", lambda d: has_tag(_text(d)))),
        ("blank_without_answer", "error", is_("blanks") & some("blanks", lambda b: ~F.coalesce(F.exists(b["accepts"], lambda a: ~empty(a)), F.lit(False)))),
        ("blank_answer_html", "error", is_("blanks") & some("blanks", lambda b: F.coalesce(F.exists(b["accepts"], lambda a: has_tag(_text(a))), F.lit(False)))),
        ("dropdown_few", "error", is_("dropdowns") & some("dropdowns", lambda b: _n(b["options"]) < 2)),
        ("dropdown_undecided", "error", is_("dropdowns") & some("dropdowns", lambda b: b["correct"].isNull() | (b["correct"] < 0) | (b["correct"] >= _n(b["options"])))),
        ("dropdown_option_empty", "error", is_("dropdowns") & some("dropdowns", lambda b: F.coalesce(F.exists(b["options"], empty), F.lit(False)))),
        ("dropdown_option_twice", "warn", is_("dropdowns") & some("dropdowns", lambda b: _twice(F.transform(b["options"], lambda o: F.lower(trimmed(_text(o))))))),
    ]
    for kind, names in ids.items():
        valid = F.filter(names, lambda i: i.rlike(BLANK_ID))
        out += [
            (f"{kind}_none", "error", is_(kind) & (_n(F.col(kind)) < 1)),
            (f"{kind}_id", "error", is_(kind) & (_n(valid) < _n(names))),
            (f"{kind}_id_twice", "error", is_(kind) & _twice(valid)),
            (f"{kind}_not_in_stem", "error", is_(kind) & some(valid, lambda i: occurrences(stem, F.concat(F.lit("["), i, F.lit("]"))) == 0)),
            (f"{kind}_often_in_stem", "error", is_(kind) & some(valid, lambda i: occurrences(stem, F.concat(F.lit("["), i, F.lit("]"))) > 1)),
            (f"{kind}_in_stimulus", "warn", is_(kind) & some(valid, lambda i: F.contains(stim, F.concat(F.lit("["), i, F.lit("]"))))),
        ]
    return out


def issues(questions: DataFrame) -> DataFrame:
    """(bank, pos, id, level, code) of every rule that a question breaks; one pass, no shuffle."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, level, c in rules()]))
    return questions.select("bank", "pos", "id", F.explode(found).alias("i")).select("bank", "pos", "id", "i.level", "i.code")


def merge_issues(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, source, ord, level, message): the first of equal (level, message tail), sorted error, warn, info."""
    tail = F.lower(collapse(F.regexp_replace("message", r"^\s*(?iu)(câu|dòng|question|item)\b[^:]{0,60}:\s*", "")))
    kept = rows.withColumn("_tail", tail).groupBy(*by, "level", "_tail").agg(F.min_by("message", F.struct("source", "ord")).alias("message"), F.min(F.struct("source", "ord")).alias("_first"))
    severity = F.array_position(F.array(F.lit("error"), F.lit("warn"), F.lit("info")), F.col("level")).cast("int")
    return kept.select(*by, "level", "message", severity.alias("severity"), F.col("_first.source").alias("source"), F.col("_first.ord").alias("ord"))


def exportable(questions: DataFrame, found: DataFrame, deselected: DataFrame) -> DataFrame:
    """Questions without an error and not deselected; the others keep their place as a row with exportable = false."""
    errors = found.where("level = 'error'").select("bank", "pos").distinct().withColumn("_e", F.lit(True))
    off = deselected.select("bank", "pos").distinct().withColumn("_d", F.lit(True))
    return questions.join(errors, ["bank", "pos"], "left").join(off, ["bank", "pos"], "left").withColumn("exportable", F.col("_e").isNull() & F.col("_d").isNull()).drop("_e", "_d")
