"""Text columns: escaping, folding, identifiers, paths.  Built-in functions, but for Unicode normal forms (Arrow)."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the source texts mean it: with no-break spaces and the byte order mark, which \\s leaves out.
WHITE = r"[\s   -     　﻿]"
FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"
TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s*/?>|\s+[A-Za-z_:][-A-Za-z0-9_:.]*\s*=)|<!--"
MEDIA = r"(?i)<(img|math|table|iframe|video|audio|object)\b"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Normal form C; null is ''."""
    return s.map(lambda x: "" if x is None else x if x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Letters without combining marks (U+0300 to U+036F), đ as d; null is ''."""

    def one(x: str | None) -> str:
        if x is None or x.isascii():
            return x or ""
        x = "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ")
        return x.replace("đ", "d").replace("Đ", "d")

    return s.map(one)


_EVERY_MARK = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c).startswith("M")) + "]+")


@F.pandas_udf(T.StringType())
def without_any_marks(s: pd.Series) -> pd.Series:
    """Letters without combining marks of any script, enclosing ones too; null is ''."""
    return s.map(lambda x: "" if x is None else x if x.isascii() else _EVERY_MARK.sub("", unicodedata.normalize("NFD", x)))


def collapse(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, WHITE + "+", " "))


def trimmed(s: Column) -> Column:
    """Without white space of any sort at the ends."""
    return F.regexp_replace(s, f"^{WHITE}+|{WHITE}+$", "")


def slug(s: Column) -> Column:
    """Lower-case ASCII letters and digits, everything between as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_marks(s)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_of_folded(folded: Column) -> Column:
    """slug for text that has no marks any more: built-ins alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_forbidden(s: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(s, FORBIDDEN, "")


def _escaped(s: Column, pairs: list[tuple[str, str]]) -> Column:
    s = F.coalesce(s, F.lit(""))
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_xml(s: Column) -> Column:
    return _escaped(strip_forbidden(s), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")])


def escape_attribute(s: Column) -> Column:
    return _escaped(strip_forbidden(s), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")])


def escape_html(s: Column) -> Column:
    return _escaped(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def has_tag(s: Column) -> Column:
    """Whether there is a real HTML tag; a<b is text."""
    return s.rlike(TAG)


def is_blank_html(s: Column) -> Column:
    """No text, picture, formula, table or media."""
    s = F.coalesce(s, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(s, "<[^>]*>", ""), "(?i)&nbsp;|&#160;|&#xa0;|\u200b", " ")
    return ~s.rlike(MEDIA) & (F.regexp_replace(text, WHITE, "") == "")


def occurrences(hay: Column, needle: Column) -> Column:
    """Occurrences without overlap; an empty needle has none."""
    n = F.length(needle)
    return F.when(n == 0, 0).otherwise(((F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))) / n).cast("int"))


def image_sources(html: Column) -> Column:
    """The src of every img tag, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def fnv1a32(s: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long."""
    octets = F.regexp_extract_all(F.hex(s.cast("binary")), F.lit(".."), F.lit(0))
    return F.aggregate(octets, F.lit(0x811C9DC5).cast("long"), lambda acc, x: (acc.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def hash6(s: Column) -> Column:
    """The 32-bit hash folded to 24 bits, six hex digits."""
    h = fnv1a32(s)
    return F.lower(F.lpad(F.hex(F.shiftrightunsigned(h, 24).bitwiseXOR(h.bitwiseAND(F.lit(0xFFFFFF).cast("long")))), 6, "0"))


def bank_ident(title: Column, slug_of: Column | None = None) -> Column:
    """nh, up to 40 characters of the slug, the hash; empty parts dropped.  title must be in normal form C."""
    t = collapse(title)
    s = F.regexp_replace(F.substring(slug(t) if slug_of is None else slug_of, 1, 40), "_+$", "")
    return F.concat_ws("_", F.lit("nh"), F.when(s != "", s), hash6(t))


def column_number(letters: Column) -> Column:
    """A is 0, Z 25, AA 26."""
    each = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999."""
    digits = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = [], n
    for value, text in digits:
        out.append(F.repeat(F.lit(text), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*out)


def resolve_path(base: Column, target: Column) -> Column:
    """target from the folder of base: backslashes, query and fragment off, . and .. resolved, a leading / from the root."""
    t = F.replace(F.regexp_replace(target, "[?#].*$", ""), F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(t.startswith("/"), t).otherwise(F.concat(folder, t)), "/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def decode_base64(s: Column) -> Column:
    """Bytes of base64 in either alphabet, white space and padding aside."""
    clean = F.regexp_replace(F.translate(s, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    return F.unbase64(F.concat(clean, F.repeat(F.lit("="), (4 - F.length(clean) % 4) % 4)))


def url_encode_twice(s: Column) -> Column:
    once = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return once(once(s))


def shorten(s: Column, n: int = 80) -> Column:
    """At most n characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.substring(s, 1, n), r"\s+\S*$", "")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(cut, F.lit("…")))


def comparison_key(s: Column) -> Column:
    """Lower case, white space collapsed, final full stops off.  s must be in normal form C."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), WHITE + "+", " "), "[.。]+$", ""))


def plain_text(html: Column) -> Column:
    """HTML as text: scripts and styles off, block tags break lines, cells a blank apart, five entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(p|div|li|ul|ol|tr|table|h[1-6]|section|article|nav|header|footer|body|html|blockquote|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</t[dh]\s*>", " "), "<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f ]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n+", "\n"), r"^\n|\n$", ""))


def unsafe_html(html: Column) -> Column:
    """Whether executable addresses or event attributes are left: the last filter after a sanitiser."""
    return html.rlike(r"(?i)<(script|iframe|object|embed|form|meta|link|base)\b") | html.rlike(r"(?i)\son[a-z]+\s*=") | html.rlike(r"(?i)(href|src|action)\s*=\s*[\"']?\s*(javascript|vbscript|data:text/html)")
