"""What stands in one cell or answer line, read as parts of a question.  Built-in functions alone."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from exalake.functions.answers import MINUS, points, variants
from exalake.functions.formats import plain_number
from exalake.functions.text import collapse, trimmed, without_marks

MOST_POINTS = 1000.0
FILE_NAME_CHARS = 60
#: Arrows between the sides of a pair, in the order in which they are looked for (fixed values).
ARROWS = ["=>", "⇒", "->", "→"]
#: Digits of a number that sorting by value takes into account.
SORT_DIGITS = 38


def _fold_table() -> tuple[str, str]:
    """Letters whose form without marks is one letter, and that letter in lower case; made from Unicode's own tables."""
    pairs = {"đ": "d", "Đ": "d"}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(plain) == 1 and plain != chr(code) and len(plain.lower()) == 1:
            pairs[chr(code)] = plain.lower()
        elif chr(code).lower() != chr(code) and len(chr(code).lower()) == 1:
            pairs.setdefault(chr(code), chr(code).lower())
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _fold_table()


def fold(s: Column) -> Column:
    """Lower case without marks, character by character, so that places in the result are places in s.  s is in normal form C."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(s, _MARKED + capitals, _PLAIN + capitals.lower())


def document_text(s: Column) -> Column:
    """Soft hyphens, zero-width spaces and byte order marks go; hard hyphens are hyphens, hard blanks and line ends blanks."""
    return F.translate(s, "‑    \r\n­​﻿", "-      ")


def file_name(s: Column, default: str = "ngan_hang") -> Column:
    """An ASCII file name that keeps its case: at most FILE_NAME_CHARS characters, no underscore at the ends."""
    plain = without_marks(F.replace(s, F.lit("Đ"), F.lit("D")))
    t = F.regexp_replace(F.regexp_replace(plain, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(t, 1, FILE_NAME_CHARS), "_+$", ""), F.lit("")), F.lit(default))


def decode_entities(s: Column) -> Column:
    """The five XML names and numbers as characters, in one pass; unknown names and numbers that are no character stay."""
    pieces = F.split(s, "&")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z_][A-Za-z0-9._-]*);", 1)
        rest = F.substr(p, F.length(name) + 2)
        digits = F.when(name.rlike("^#[xX]"), F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1)).otherwise(F.hex(F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1).try_cast("long")))
        code = F.conv(digits, 16, 10).try_cast("long")
        real = name.startswith("#") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">").when(name == "quot", '"').when(name == "apos", "'").when(real, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), p))

    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")


def bytes_text(b: Column) -> Column:
    """UTF-8 bytes as text: a byte order mark goes, bad bytes become the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(b.cast("string")), "^﻿", "")


def shown_number(x: Column) -> Column:
    """A number as people read it: at most four decimals, a decimal comma, a true minus sign."""
    return F.replace(F.replace(plain_number(F.round(x, 4)), F.lit("-"), F.lit(MINUS)), F.lit("."), F.lit(","))


def typed_points(s: Column) -> Column:
    """points() as a form takes them: at most MOST_POINTS, four decimals; else null."""
    p = points(s)
    return F.when(p <= MOST_POINTS, F.round(p, 4))


def _number(s: Column) -> Column:
    t = F.regexp_replace(F.replace(s, F.lit(MINUS), F.lit("-")), r"\s+", "")
    return F.when(t.rlike(r"^[-+]?(\d+([.,]\d+)?|[.,]\d+)([eE][-+]?\d+)?$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def sheet_numeric(s: Column, cell: Column | None = None) -> Column:
    """(exact, margin, min, max) of an answer cell: a number in the cell wins; 'x ± d' is a margin, 'a .. b' a span as written."""
    t = trimmed(F.coalesce(s, F.lit("")))
    void = F.lit(None).cast("double")
    of = lambda e, m, a, b: F.struct(e.alias("exact"), m.alias("margin"), a.alias("min"), b.alias("max"))
    near = F.transform(F.split(t, r"\s*(?:±|\+\s*/\s*-|\+\s*-)\s*"), _number)
    span = F.transform(F.split(t, r"\s*(?:\.\.\.?|…)\s*"), _number)
    at = lambda x, i: F.get(x, F.lit(i))
    zero = F.lit(0.0)
    cell = void if cell is None else cell
    said = (
        F.when(F.size(near) == 2, F.when(at(near, 0).isNotNull() & (at(near, 1) >= 0), of(at(near, 0), at(near, 1), void, void)))
        .when(F.size(span) == 2, F.when(at(span, 0).isNotNull() & at(span, 1).isNotNull(), of(void, void, at(span, 0), at(span, 1))))
        .otherwise(F.when(_number(t).isNotNull(), of(_number(t), zero, void, void)))
    )
    return F.when(cell.isNotNull() & ~F.isnan(cell), of(cell, zero, void, void)).otherwise(said)


def numeric_bounds(numeric: Column) -> Column:
    """(low, high) that an answer may have.  Margins are taken in decimals, so 0.3 with 0.1 ends at 0.2 and 0.4.

    Where decimals can't hold both numbers (from 1e20 on, or with more than 18 places) the margin is taken as doubles are.
    """
    said, margin = numeric["exact"], F.greatest(F.coalesce(numeric["margin"], F.lit(0.0)), F.lit(0.0))
    exact, near = said.try_cast("decimal(38,18)"), margin.try_cast("decimal(38,18)")
    held = F.coalesce((exact.cast("double") == said) & (near.cast("double") == margin), F.lit(False))
    low = F.when(margin == 0, said).when(held, F.try_subtract(exact, near).cast("double")).otherwise(said - margin)
    high = F.when(margin == 0, said).when(held, F.try_add(exact, near).cast("double")).otherwise(said + margin)
    return F.struct(F.when(numeric["exact"].isNotNull(), low).otherwise(numeric["min"]).alias("low"), F.when(numeric["exact"].isNotNull(), high).otherwise(numeric["max"]).alias("high"))


BOX = r"\[\[([\s\S]*?)\]\]"


def boxes(content: Column) -> Column:
    """The boxes [[a|b]] of a content, in order: id (b1, b2, ...), options (trimmed, stars off) and starred (their places)."""

    def one(raw: Column, i: Column) -> Column:
        options = F.transform(F.split(raw, r"\|"), trimmed)
        starred = F.filter(F.transform(options, lambda o, j: F.when(o.startswith("*"), j)), lambda j: j.isNotNull())
        return F.struct(F.concat(F.lit("b"), (i + 1).cast("string")).alias("id"), F.transform(options, lambda o: F.regexp_replace(o, r"^\*\s*", "")).alias("options"), starred.alias("starred"))

    return F.transform(F.regexp_extract_all(content, F.lit(BOX), F.lit(1)), one)


def content_with_ids(content: Column) -> Column:
    """The content with [b1], [b2], ... where its boxes stand."""
    pieces = F.split(content, BOX)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i + 1 < F.size(pieces), F.concat(p, F.lit("[b"), (i + 1).cast("string"), F.lit("]"))).otherwise(p)), "")


def blanks(boxes_of: Column) -> Column:
    """Boxes to fill in: id and accepts."""
    return F.transform(boxes_of, lambda b: F.struct(b["id"].alias("id"), variants(b["options"]).alias("accepts")))


def dropdowns(boxes_of: Column) -> Column:
    """Boxes to choose in: id, options and correct, null unless exactly one option has a star."""
    return F.transform(boxes_of, lambda b: F.struct(b["id"].alias("id"), b["options"].alias("options"), F.when(F.size(b["starred"]) == 1, F.get(b["starred"], F.lit(0))).alias("correct")))


def pair_sides(cell: Column) -> Column:
    """(left, right) of a cell, parted at the first arrow of the first sort that stands in it; null without one."""
    at = lambda a: F.instr(cell, a)
    sides = [F.when(at(a) > 0, F.struct(F.regexp_replace(F.substr(cell, F.lit(1), at(a) - 1), r"\s+$", "").alias("left"), collapse(F.substr(cell, at(a) + len(a))).alias("right"))) for a in ARROWS]
    return F.coalesce(*sides)


def matching(cells: Column) -> Column:
    """(pairs, distractors) of option cells: cells with an arrow are pairs; others, or a list after 'Nhiễu:', are distractors."""
    given = F.filter(cells, lambda c: trimmed(F.coalesce(c, F.lit(""))) != "")

    def alone(c: Column) -> Column:
        t = collapse(c)
        listed = F.filter(F.transform(F.split(F.regexp_replace(t, r"(?iu)^nhi[eễ]u\s*:\s*", ""), ";"), trimmed), lambda x: x != "")
        return F.when(pair_sides(c).isNotNull(), F.array().cast("array<string>")).when(F.lower(t).rlike(r"^nhi[eễ]u\s*:"), listed).otherwise(F.array(t))

    return F.struct(F.array_compact(F.transform(given, pair_sides)).alias("pairs"), F.flatten(F.transform(given, alone)).alias("distractors"))


def sort_key(s: Column) -> Column:
    """Vietnamese order without case and marks, numbers by value (SORT_DIGITS digits of them)."""
    padded = F.regexp_replace(F.regexp_replace(s, r"(\d+)", "0" * SORT_DIGITS + "$1"), r"\d*(\d{%d})(?!\d)" % SORT_DIGITS, "$1")
    return F.collate(padded, "vi_CI_AI")


def right_sides(pairs: Column, distractors: Column) -> Column:
    """The distinct right sides and distractors in alphabetical order, so that their order tells nothing."""
    every = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["right"]), distractors))
    return F.transform(F.sort_array(F.transform(every, lambda t: F.struct(sort_key(t).alias("k"), t.alias("t")))), lambda x: x["t"])


def spellings(s: Column) -> Column:
    """Accepted spellings of a document's answer: parted at ; and | outside brackets; blank ones go."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "[", "{"), acc["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        cut = c.isin(";", "|") & (depth == 0)
        return F.struct(F.when(cut, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(cut, "").otherwise(F.concat(acc["open"], c)).alias("open"), depth.alias("depth"))

    every = F.aggregate(F.split(s, ""), start, step, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.filter(F.transform(every, trimmed), lambda x: x != "")


def document_letters(s: Column) -> Column:
    """Option letters of a document's answer: 'B', 'A, C', 'AC', 'Chọn B', 'B. text', or shares 'A=30, B=-10' (above 0 is right).

    Reading ends at the first other word; null if there is no letter.
    """
    t = F.regexp_replace(trimmed(s), r"(?iu)^(?:chọn|chon|đáp\s*án|dap\s*an|phương\s+án|phuong\s+an)\s*:?\s*", "")
    words = F.filter(F.split(t, r"[\s,;&+/]+"), lambda x: (x != "") & ~x.rlike("(?i)^(và|va|and)$"))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        share = F.replace(F.regexp_extract(x, r"^[A-H]=([-+]?\d+(?:[.,]\d+)?)%?$", 1), F.lit(","), F.lit("."))
        got = (
            F.when(x.rlike(r"^\*?[A-Ha-h][.):]?$"), F.array(F.upper(F.regexp_extract(x, "([A-Ha-h])", 1))))
            .when(share != "", F.when(share.try_cast("double") > 0, F.array(F.substring(x, 1, 1))).otherwise(none))
            .when((F.size(acc["out"]) == 0) & x.rlike(r"^[A-H]{2,8}\.?$"), F.filter(F.split(F.replace(x, F.lit("."), F.lit("")), ""), lambda c: c != ""))
        )
        ended = acc["ended"] | got.isNull()
        return F.struct(F.when(ended, acc["out"]).otherwise(F.concat(acc["out"], got)).alias("out"), ended.alias("ended"))

    out = F.array_distinct(F.aggregate(words, F.struct(none.alias("out"), F.lit(False).alias("ended")), step, lambda acc: acc["out"]))
    return F.when(F.size(out) > 0, out)


def document_true_false(s: Column, labels: Column) -> Column:
    """(marks, missing, extra) of a document's true and false answer: by label ('a-Đ, b) Sai') or in order ('ĐSĐS').

    A label that is unknown or comes twice makes the whole text one in order.  Null if it reads neither way.
    """
    t = F.upper(F.coalesce(s, F.lit("")))
    for pattern, mark in ((r"ĐÚNG|DUNG\b", "Đ"), (r"SAI\b", "S"), ("TRUE", "T"), ("FALSE", "F")):
        t = F.regexp_replace(t, pattern, mark)
    keyed = r"([A-H])\s*[).:\-–=]\s*([ĐSTFD])(?![A-ZĐ])"
    names, said = F.transform(F.regexp_extract_all(t, F.lit(keyed), F.lit(1)), F.lower), F.regexp_extract_all(t, F.lit(keyed), F.lit(2))
    right = lambda c: c.isin("Đ", "T", "D")
    sound = (F.size(names) > 0) & (F.size(F.array_distinct(names)) == F.size(names)) & (F.size(F.array_except(names, labels)) == 0)
    row = F.regexp_replace(t, r"[\s,;.\-–/|()]", "")
    marks = F.filter(F.split(row, ""), lambda c: c != "")
    n = F.least(F.size(marks), F.size(labels))
    of = lambda m, missing, extra: F.struct(m.alias("marks"), missing.alias("missing"), extra.alias("extra"))
    in_order = of(F.map_from_arrays(F.slice(labels, F.lit(1), n), F.transform(F.slice(marks, F.lit(1), n), right)), F.slice(labels, n + 1, F.size(labels)), F.size(marks) > F.size(labels))
    return F.when(sound, of(F.map_from_arrays(names, F.transform(said, right)), F.array_except(labels, names), F.lit(False))).when(row.rlike("^[ĐSTFD]+$"), in_order)


def short_variants(answers: Column, loose: bool = False) -> Column:
    """Accepted spellings of short answers written with markup: as they are, with the other sort of apostrophe or straight quotes,
    without punctuation at the end; loosely, also with hyphens between letters as blanks or left out, and without an
    article before three words or fewer; then `variants` of all these.  Texts must be in normal form C."""
    clean = F.transform(answers, lambda s: collapse(decode_entities(F.replace(F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" ")))))
    kept = lambda xs: F.array_distinct(F.filter(F.transform(xs, collapse), lambda s: s != ""))
    no = F.lit(None).cast("string")

    def written(a: Column) -> Column:
        apostrophe = F.when(a.rlike("[‘’ʼ]"), F.translate(a, "‘’ʼ", "'''")).when(a.rlike("[A-Za-z]'[A-Za-z]"), F.replace(a, F.lit("'"), F.lit("’")))
        return F.array(a, apostrophe, F.when(a.rlike("[“”]"), F.translate(a, "“”", '""')))

    def bound(x: Column, f) -> Column:
        """f(x) with x worked out once, however often f names it."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def more(xs: Column, one) -> Column:
        return bound(xs, lambda v: kept(F.concat(v, F.array_compact(F.flatten(F.transform(v, one))))))

    base = kept(F.array_compact(F.flatten(F.transform(F.filter(clean, lambda s: s != ""), written))))
    base = more(base, lambda a: F.array(F.regexp_replace(a, r"\s*[.,;:!?]+$", "")))
    if loose:
        hyphen, article = "([A-Za-z])-(?=[A-Za-z])", r"(?i)^(?:an?|the)\s+([A-Za-z].*)$"
        base = more(base, lambda a: F.when(a.rlike(hyphen), F.array(F.regexp_replace(a, hyphen, "$1 "), F.regexp_replace(a, hyphen, "$1"))).otherwise(F.array(no)))
        rest = lambda a: F.regexp_extract(a, article, 1)
        base = more(base, lambda a: F.array(F.when((rest(a) != "") & (F.size(F.split(rest(a), " ")) <= 3), rest(a))))
    return bound(base, variants)
