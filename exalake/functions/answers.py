"""Answers as texts: points, numbers, ranges, option letters, variants.  Built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exalake.functions.text import collapse, trimmed

MINUS = "−"


def _double(s: Column) -> Column:
    return s.try_cast("double")


def points(s: Column) -> Column:
    """'0,25', '.5', '1đ', '(0,5 điểm)', '2 pts' as a number that is not negative; else null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(collapse(F.lower(s)), r"^[(\[]\s*", ""), r"\s*[)\]]$", ""))
    number = F.regexp_extract(t, r"^(\d+(?:[.,]\d+)?|[.,]\d+)\s*(?:đ|đ\.|điểm|diem|d|pts?|points?|p)?$", 1)
    return F.when(number != "", _double(F.replace(number, F.lit(","), F.lit("."))))


def sheet_number(s: Column) -> Column:
    """A spreadsheet's number: one decimal mark, an exponent, no thousands."""
    t = F.replace(F.replace(F.regexp_replace(s, r"\s", ""), F.lit(MINUS), F.lit("-")), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), _double(t))


def document_number(s: Column) -> Column:
    """A document's number: of mixed marks the later is the decimal one; a repeated mark parts thousands; no exponent."""
    t = F.regexp_replace(F.replace(s, F.lit(MINUS), F.lit("-")), r"\s+", "")
    commas, dots = F.length(F.regexp_replace(t, "[^,]", "")), F.length(F.regexp_replace(t, "[^.]", ""))
    last = lambda c: F.length(t) - F.instr(F.reverse(t), c)
    no = lambda x, c: F.replace(x, F.lit(c), F.lit(""))
    point = lambda x: F.regexp_replace(x, "^([^,]*),", "$1.")
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(last(",") > last("."), point(no(t, "."))).otherwise(no(t, ",")))
        .when(commas > 1, no(t, ","))
        .when(commas == 1, point(t))
        .when(dots > 1, no(t, "."))
        .otherwise(t)
    )
    return F.when(t.rlike(r"^[-+]?(\d+([.,]\d+)*|[.,]\d+)$"), F.regexp_replace(plain, r"^([-+]?\d+(?:\.\d+)?).*$", "$1").try_cast("double"))


def numeric_answer(s: Column) -> Column:
    """'x ± d' and a number as (exact, margin), 'a .. b' as (min, max) in order; null if neither."""
    t = F.regexp_replace(F.trim(s), r"\.$", "")
    tolerance, span = r"^(.+?)\s*(?:±|\+/-|\+-)\s*(.+)$", r"^(.+?)\s*(?:\.\.\.?|…)\s*(.+)$"
    texts = F.array(*[F.regexp_extract(t, p, g) for p in (tolerance, span) for g in (1, 2)], t)
    null = F.lit(None).cast("double")
    make = lambda exact, margin, low, high: F.struct(exact.alias("exact"), margin.alias("margin"), low.alias("min"), high.alias("max"))

    def built(n: Column) -> Column:
        return (
            F.when(t.rlike(tolerance), F.when(n[0].isNotNull() & n[1].isNotNull(), make(n[0], F.abs(n[1]), null, null)))
            .when(t.rlike(span), F.when(n[2].isNotNull() & n[3].isNotNull(), make(null, null, F.least(n[2], n[3]), F.greatest(n[2], n[3]))))
            .otherwise(F.when(n[4].isNotNull(), make(n[4], F.lit(0.0), null, null)))
        )

    # the numbers are worked out once, as an array; the outer transform gives them a name
    return F.get(F.transform(F.array(F.transform(texts, document_number)), built), F.lit(0))


def looks_like_range(s: Column) -> Column:
    return s.rlike(r"^(.+?)\s*(?:±|\+/-|\+-)\s*(.+)$") | s.rlike(r"^(.+?)\s*(?:\.\.\.?|…)\s*(.+)$")


def option_letters(s: Column) -> Column:
    """A to H in first-seen order, a lead word aside, from 'A, C', 'AC', 'A và C'; null if anything else is in the text."""
    t = F.regexp_replace(trimmed(F.upper(s)), r"^(?:ĐÁP ÁN|DAP AN|ANSWER|PHƯƠNG ÁN)\s*[:.\-]?\s*|^ĐA\s*[:.\-]\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(^|\s)(?:VÀ|VA|AND|HOẶC|HOAC)(?=\s|$)", "$1"), r"[\s,;/&+.|()\-]+", "")
    letters = F.filter(F.split(t, ""), lambda c: c != "")
    return F.when(t.rlike("^[A-H]+$"), F.array_distinct(letters))


#: Words for true and false, in the order in which they are tried (fixed values).
TRUE_FALSE = "ĐÚNG|DUNG|SAI|TRUE|FALSE|Đ|D|S|T|F"
LABELLED_TRUE_FALSE = rf"([A-H])\s*[).:=\-]?\s*({TRUE_FALSE})(?!\p{{L}})"


def _is_true(word: Column) -> Column:
    return word.isin("ĐÚNG", "DUNG", "TRUE", "Đ", "D", "T")


def true_false(s: Column) -> Column:
    """(labelled, in_order) of 'a-Đ, b-S', 'a) Đúng b) Sai', 'ĐSĐS', 'Đúng; Sai': marks by label, and marks in order.

    Each is null where the text doesn't read so.
    """
    u = trimmed(F.upper(s))
    labels, words = [F.regexp_extract_all(u, F.lit(LABELLED_TRUE_FALSE), F.lit(g)) for g in (1, 2)]
    labelled = F.zip_with(labels, words, lambda k, w: F.struct(F.lower(k).alias("label"), _is_true(w).alias("value")))
    rest = F.regexp_replace(u, LABELLED_TRUE_FALSE, "")
    t = F.regexp_replace(u, r"[\s,;.\-/|()+:]+", "")
    marks = F.regexp_extract_all(t, F.lit(f"({TRUE_FALSE})"), F.lit(1))
    return F.struct(F.when((F.size(labels) > 0) & rest.rlike(r"^[\s,;.|/]*$"), labelled).alias("labelled"), F.when((t != "") & (F.array_join(marks, "") == t), F.transform(marks, _is_true)).alias("in_order"))


def true_false_of(marks: Column, labels: Column) -> Column:
    """The marks of true_false for statements with these labels as a map; null unless each has one."""
    by_label, in_order = marks["labelled"], marks["in_order"]
    named = F.transform(by_label, lambda m: m["label"])
    full = (F.size(by_label) == F.size(labels)) & (F.size(F.array_distinct(named)) == F.size(labels)) & (F.size(F.array_except(labels, named)) == 0)
    return F.when(full, F.map_from_entries(by_label)).when(F.size(in_order) == F.size(labels), F.map_from_arrays(labels, in_order))


def variants(answers: Column) -> Column:
    """Accepted spellings: the originals first, then decimal comma and point twins and both minus signs; case aside distinct."""
    clean = F.filter(F.transform(answers, lambda s: collapse(F.coalesce(s, F.lit("")))), lambda s: s != "")

    def twins(s: Column) -> Column:
        other = F.when(s.rlike(r"\d,\d"), F.regexp_replace(s, r"(\d),(?=\d)", "$1.")).when(s.rlike(r"\d\.\d"), F.regexp_replace(s, r"(\d)\.(?=\d)", "$1,"))
        sign = lambda x: F.when(F.instr(x, MINUS) > 0, F.replace(x, F.lit(MINUS), F.lit("-"))).when(F.instr(x, "-") > 0, F.replace(x, F.lit("-"), F.lit(MINUS)))
        return F.array_compact(F.array(s, sign(s), other, sign(other)))

    every = F.concat(clean, F.flatten(F.transform(clean, twins)))
    lower = F.transform(every, lambda s: F.lower(s))
    return F.filter(every, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)


def percent_share(n: Column) -> Column:
    """100 / n with two decimals, as text."""
    return F.format_string("%.2f", F.lit(100.0) / n)


def looks_like_key(v: Column, strict: bool = False) -> Column:
    """Whether a value looks like an answer: letters, true and false marks, a number; unless strict also a few short words."""
    t = F.trim(v)
    sure = t.rlike(r"^\*?[A-H](?:\s*[,;&]?\s*[A-H])*\.?$") | t.rlike("^[-+−]?\\d+(?:[.,]\\d+)?$") | t.rlike("(?i)^(?:TRUE|FALSE|NOT GIVEN|YES|NO)$")
    sure = sure | t.rlike(r"^(?:[a-h]\s*[).:\-]?\s*)?[ĐSTFđs](?:\s*[;,]?\s*(?:[a-h]\s*[).:\-]?\s*)?[ĐSTFđs])*$")
    return sure if strict else sure | ((F.length(t) <= 25) & (F.size(F.split(t, r"\s+")) <= 3) & ~t.rlike("[.?!:]$"))
