"""Numbers of cells as their format shows them: percent, fractions, dates, times.  Built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _when_id(fmt_id: Column, table: dict[tuple[int, ...], object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for ids, value in table.items():
        out = F.when(fmt_id.isin(*ids), F.lit(value).cast(kind)).otherwise(out)
    return out


def classify(fmt_id: Column, code: Column) -> Column:
    """kind (percent, fraction, date, time, datetime, elapsed), places, top and fixed denominator, year, seconds, code; null if plain.

    Built-in ids first; own codes (from 164 on) by their letters, quoted text, escapes, colours and regions aside.
    """
    east = tuple(range(27, 37)) + tuple(range(50, 59))
    kind = _when_id(fmt_id, {(9, 10): "percent", (12, 13): "fraction", (14, 15, 16, 17, *east): "date", (18, 19, 20, 21, 45, 47): "time", (46,): "elapsed", (22,): "datetime"}, "string")
    c = F.split(F.coalesce(code, F.lit("")), ";")[0]
    elapsed = c.rlike(r"(?i)\[(h+|m+|s+)\]")
    for pattern in ('"[^"]*"', r"\\.", "[_*].", r"\[[^\]]*\]"):
        c = F.regexp_replace(c, pattern, "")
    c = F.trim(c)
    own = (fmt_id >= 164) & (c != "") & ~c.rlike("(?i)^(general|@)$") | (fmt_id >= 164) & elapsed
    hours, day = c.rlike("(?i)[hs]"), c.rlike("(?i)[yd]") | (c.rlike("(?i)m") & ~c.rlike("(?i)[hs]") & ~c.rlike("[0#?]"))
    part = r"[?#0]+\s*/\s*([?#0]+|\d+)"
    below = F.regexp_extract(c, part, 1)
    own_kind = F.when(elapsed, "elapsed").when(day, F.when(hours, "datetime").otherwise("date")).when(hours, "time").when(c.contains("%"), "percent").when(below != "", "fraction")
    of_id = kind.isNotNull()
    places = F.when(of_id, F.when(fmt_id == 10, 2).otherwise(0)).otherwise(F.length(F.regexp_extract(c, r"\.(0+)", 1)))
    fixed = F.when(~of_id & below.rlike(r"^\d+$"), below.try_cast("int"))
    top = F.when(fmt_id == 12, 9).when(fmt_id == 13, 99).otherwise(F.pow(F.lit(10), F.length(below)).cast("int") - 1)
    year = F.when(of_id, fmt_id != 16).otherwise(c.rlike("(?i)y"))
    seconds = F.when(of_id, fmt_id.isin(19, 21, 45, 46, 47)).otherwise(F.coalesce(code, F.lit("")).rlike("(?i)s"))
    full = F.struct(F.coalesce(kind, own_kind).alias("kind"), places.alias("places"), top.alias("top"), fixed.alias("fixed"), year.alias("year"), seconds.alias("seconds"), F.when(~of_id, c).alias("code"))
    return F.when(of_id | (own & own_kind.isNotNull()), full)


def plain_number(x: Column) -> Column:
    """A double without noise: at most 15 significant digits, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.15g", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def fraction(v: Column, f: Column) -> Column:
    """The nearest fraction: a fixed denominator, or the first of the best up to the top one."""
    x = F.abs(v)
    whole = F.floor(x)
    rest = x - whole
    each = F.transform(F.sequence(F.lit(1), F.greatest(f["top"], F.lit(1))), lambda q: F.struct(F.round(F.abs(rest - F.round(rest * q) / q), 12).alias("e"), q.alias("q")))
    below = F.coalesce(f["fixed"], F.array_min(each)["q"])
    above = F.round(rest * below).cast("int")
    carry = above == below
    whole, above = whole + carry.cast("int"), F.when(carry, 0).otherwise(above)
    sign = F.when((v < 0) & ((whole > 0) | (above > 0)), "-").otherwise("")
    body = F.when(above > 0, F.concat(F.when(whole > 0, F.concat(whole.cast("string"), F.lit(" "))).otherwise(""), above.cast("string"), F.lit("/"), below.cast("string"))).otherwise(whole.cast("string"))
    return F.concat(sign, body)


def _date_text(day: Column, f: Column) -> Column:
    """By a code of two or three parts (d, m, y in any order); otherwise day/month and, with a year, /year."""
    pattern = r"(?i)^(d{1,2}|m{1,2}|y{2,4})([/.\-])(d{1,2}|m{1,2}|y{2,4})(?:\2(d{1,2}|m{1,2}|y{2,4}))?$"
    code = F.regexp_replace(F.coalesce(f["code"], F.lit("")), r"\s+", "")
    part = lambda g: F.regexp_extract(code, pattern, g)

    def one(p: Column) -> Column:
        number = F.when(F.lower(F.substring(p, 1, 1)) == "d", F.day(day)).otherwise(F.month(day))
        year = F.when(F.length(p) > 2, F.year(day).cast("string")).otherwise(_two(F.year(day) % 100))
        return F.when(p == "", None).when(F.lower(F.substring(p, 1, 1)) == "y", year).when(F.length(p) > 1, _two(number)).otherwise(number.cast("string"))

    usual = F.concat_ws("/", _two(F.day(day)), _two(F.month(day)), F.when(f["year"], F.year(day).cast("string")))
    return F.when(code.rlike(pattern), F.call_function("concat_ws", part(2), one(part(1)), one(part(3)), one(part(4)))).otherwise(usual)


def shown(v: Column, f: Column, epoch_1904: Column | None = None) -> Column:
    """A number under a format of classify, as text; null where the number stays as it is (no format, out of range)."""
    since_1904 = F.lit(False) if epoch_1904 is None else epoch_1904
    day = F.floor(v + 1e-9)
    second = F.round((v - day) * 86400).cast("long")
    day, second = day + (second >= 86400).cast("int"), F.when(second >= 86400, second - 86400).otherwise(second)
    date = F.when(since_1904, F.date_add(F.lit("1904-01-01").cast("date"), day.cast("int"))).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), (day + (day < 60).cast("int")).cast("int")))
    clock = F.concat(F.floor(second / 3600).cast("string"), F.lit(":"), _two(F.floor(second % 3600 / 60)))
    all_seconds = F.round(v * 86400).cast("long")
    elapsed = F.concat(F.floor(all_seconds / 3600).cast("string"), F.lit(":"), _two(F.floor(all_seconds % 3600 / 60)), F.when(f["seconds"], F.concat(F.lit(":"), _two(all_seconds % 60))).otherwise(""))
    percent = F.when(f["places"] == 0, F.format_string("%.0f%%", v * 100)).when(f["places"] == 1, F.format_string("%.1f%%", v * 100)).when(f["places"] == 2, F.format_string("%.2f%%", v * 100)).otherwise(F.concat(plain_number(v * 100), F.lit("%")))
    timed = (
        F.when(f["kind"] == "elapsed", elapsed)
        .when(f["kind"] == "time", F.concat(clock, F.when(f["seconds"], F.concat(F.lit(":"), _two(second % 60))).otherwise("")))
        .when(f["kind"] == "datetime", F.concat(_date_text(date, f), F.lit(" "), clock))
        .otherwise(_date_text(date, f))
    )
    return F.when(f["kind"] == "percent", percent).when(f["kind"] == "fraction", fraction(v, f)).when(f.isNotNull() & (v >= 0) & (v < 2958466), timed)
