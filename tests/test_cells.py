"""Answer cells, banks and export checks on small literal cases, odd rows among them."""

import pytest
from pyspark.sql import functions as F

from exalake.functions import cells
from exalake.operators import banks, exports


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("12,5", (12.5, 0.0, None, None)), ("12,5 ± 0,1", (12.5, 0.1, None, None)), ("5 .. 1", (None, None, 5.0, 1.0)), ("1,5…2", (None, None, 1.5, 2.0)), ("−3", (-3.0, 0.0, None, None)),
        ("1 +/- -2", None), ("", None), (None, None), ("x .. 2", None),
    ],
)
def test_sheet_numeric(spark, given, want):
    got = one(spark, cells.sheet_numeric(F.col("s")), s=given)
    assert (tuple(got) if got else None) == want


def test_numeric_bounds_are_decimal(spark):
    for said, low, high in (("1e25", 1e25, 1e25), ("1e-13 ± 1e-14", 9e-14, 1.1e-13), ("1e25 ± 1", 1e25, 1e25), ("1e-30 ± 1e-30", 0.0, 2e-30), ("5 ± 0", 5.0, 5.0), ("1e300 ± 1e300", 0.0, 2e300)):
        got = one(spark, cells.numeric_bounds(cells.sheet_numeric(F.col("s"))), s=said)
        assert (got.low, got.high) == (low, high), said
    got = one(spark, cells.numeric_bounds(cells.sheet_numeric(F.col("s"))), s="0.3 ± 0.1")
    assert (got["low"], got["high"]) == (0.2, 0.4)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a &lt;b&gt; &amp;lt; &quot;&apos;", "a <b> &lt; \"'"), ("&#160;&#xE1;&#128512;", "\xa0á😀"), ("&nbsp; &x &#0; &#xD800; &#x110000; &", "&nbsp; &x &#0; &#xD800; &#x110000; &"), ("", ""), (None, None),
    ],
)
def test_decode_entities(spark, given, want):
    assert one(spark, cells.decode_entities(F.col("s")), s=given) == want


def test_fold_keeps_places(spark):
    text = "Đáp án: Ỗ ệ ß ﬁ İ 😀 Ä"
    assert one(spark, cells.fold(F.col("s")), s=text) == "dap an: o e ß ﬁ i 😀 a"


def test_document_text(spark):
    assert one(spark, cells.document_text(F.col("s")), s="a­b​﻿ c‑d e f\r\n") == "ab c-d e f  "


def test_bytes_text(spark):
    row = spark.createDataFrame([(b"\xef\xbb\xbfa\xffb",)], "b binary")
    assert row.select(cells.bytes_text(F.col("b"))).first()[0] == "a�b"


@pytest.mark.parametrize(("given", "want"), [(1234.5, "1234,5"), (-0.25, "−0,25"), (2.0, "2"), (0.00004, "0")])
def test_shown_number(spark, given, want):
    assert one(spark, cells.shown_number(F.col("x0")), x0=given) == want


@pytest.mark.parametrize(("given", "want"), [("a => b => c", ("a", "b => c")), ("x → 0 ⇒ y", ("x → 0", "y")), ("a->  b  c", ("a", "b c")), ("none", None), ("", None), (None, None)])
def test_pair_sides(spark, given, want):
    got = one(spark, cells.pair_sides(F.col("s")), s=given)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("given", "want"), [("a; b|c", ["a", "b", "c"]), ("f(x;y); [1|2]", ["f(x;y)", "[1|2]"]), ("a);b", ["a)", "b"]), ("", []), (" ; ", [])])
def test_spellings(spark, given, want):
    assert one(spark, cells.spellings(F.col("s")), s=given) == want


@pytest.mark.parametrize(("given", "want"), [("A và C", ["A", "C"]), ("ABBA", ["A", "B"]), ("A=-1", None), ("Đáp án: b.", ["B"]), ("B. Hà Nội", ["B"]), ("Hà", None), ("", None)])
def test_document_letters(spark, given, want):
    assert one(spark, cells.document_letters(F.col("s")), s=given) == want


def test_options_in_vietnamese_order(spark):
    row = spark.createDataFrame([([("x", "d10"), ("y", "đ"), ("z", "D9")], ["d9", "b", "b"])], "pairs array<struct<left:string,right:string>>, more array<string>")
    assert row.select(cells.right_sides(F.col("pairs"), F.col("more"))).first()[0] == ["b", "D9", "d9", "d10", "đ"]


def test_merge_titles_without_title(spark):
    rows = spark.createDataFrame([(1, None), (2, " a  B "), (3, "A b"), (4, "")], "n int, title string")
    got = {r["n"]: (r["bank"], r["pos"]) for r in banks.merge_titles(rows, "title", "n").collect()}
    assert got == {1: ("", 1), 2: ("a B", 1), 3: ("a B", 2), 4: ("", 2)}


def test_option_gaps(spark):
    gaps = lambda *filled: spark.range(1).select(exports.option_gaps(F.array(*[F.lit(x) for x in filled]).cast("array<string>"), F.array(*[F.lit(x) for x in "ABCD"]))).first()[0]
    assert gaps("A", "D") == ["B", "C"] and gaps("A", "B") == [] and gaps() == []


def test_empty_tables(spark):
    questions = spark.createDataFrame([], "bank string, pos int, type string, points double")
    issues, off = spark.createDataFrame([], "bank string, pos int, level string"), spark.createDataFrame([], "bank string, pos int")
    assert banks.bank_summary(questions, issues, off).count() == 0
    assert banks.banks_to_export(questions, issues, off).count() == 0
    items = spark.createDataFrame([], "bank string, title string, points double")
    assert exports.package_plan(items, classic=True).count() == 0 and exports.package_plan(items, classic=False).count() == 0


def test_short_variants(spark):
    got = lambda texts, loose=False: [r[0] for r in spark.createDataFrame([(texts,)], "s array<string>").select(cells.short_variants(F.col("s"), loose)).collect()][0]
    assert got(["<b>don’t</b> &amp;  go.", "it's", "“so”", None, " "]) == ["don’t & go.", "don't & go.", "it's", "it’s", "“so”", '"so"', "don’t & go", "don't & go"]
    assert got(["a door", "the well-known old man of it", "1,5"], True) == ["a door", "the well-known old man of it", "1,5", "the well known old man of it", "the wellknown old man of it", "door", "the well−known old man of it", "1.5"]
    assert got(["An e-mail!"], True)[:4] == ["An e-mail!", "An e-mail", "An e mail!", "An email!"] and "email" in got(["An e-mail!"], True)
    assert got([]) == [] and got(None) is None
