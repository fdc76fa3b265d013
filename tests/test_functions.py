"""Literal vectors of column functions and small cases of operators."""

import io
import zipfile

from pyspark.sql import functions as F

from exalake.functions import answers, text
from exalake.operators import answer_key, grading, integrity, ordered, packages, sheets, validation
from exalake.sources import files


def values(spark, given, f, kind="string"):
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_identifiers(spark):
    assert values(spark, ["a", ""], text.hash6) == ["0c29c8", "1c9d44"]
    assert values(spark, ["Đề thi  Toán 12!", "  "], text.slug) == ["de_thi_toan_12", ""]
    assert values(spark, ["Toán  12"], text.bank_ident)[0].startswith("nh_toan_12_")


def test_escaping_and_html(spark):
    assert values(spark, ["a<b & \"c\"\r", None], text.escape_xml) == ['a&lt;b &amp; "c"&#13;', ""]
    assert values(spark, ["\t\"<"], text.escape_attribute) == ["&#9;&quot;&lt;"]
    assert values(spark, ["a<b", "x < y", "<b>x</b>", "<br/>", "<img src=x>", "<!-- -->"], text.has_tag) == [False, False, True, True, True, True]
    assert values(spark, ["<p>&nbsp; </p>", "<img src='a'>", "x", None], text.is_blank_html) == [True, False, False, True]
    assert values(spark, ["<p>a</p><script>x()</script><p>b&lt;c<br>d</p>"], text.plain_text) == ["a\nb<c\nd"]
    assert values(spark, ["<a href='javascript:x'>", "<a href='b'>", "<p onclick=x>"], text.unsafe_html) == [True, False, True]
    assert values(spark, ["aXbXXc", "", "X"], lambda c: text.occurrences(c, F.lit("X"))) == [3, 0, 1]


def test_small_texts(spark):
    assert values(spark, ["A", "Z", "AA", "BC"], text.column_number) == [0, 25, 26, 54]
    assert values(spark, [1, 4, 9, 14, 1994], text.roman, "int") == ["I", "IV", "IX", "XIV", "MCMXCIV"]
    assert values(spark, ["../img/a.png?x#y", "/b/./c", "d\\e"], lambda c: text.resolve_path(F.lit("x/y/z.html"), c)) == ["x/img/a.png", "b/c", "x/y/d/e"]
    assert values(spark, ["aGk_", "a G k="], text.decode_base64) == [b"hi?", b"hi"]
    assert values(spark, ["a b+c"], text.url_encode_twice) == ["a%2520b%252Bc"]
    assert values(spark, ["short", "one two three"], lambda c: text.shorten(c, 9)) == ["short", "one two…"]


def test_points_and_numbers(spark):
    assert values(spark, ["0,25", "0.25", ".5", "1đ", "(0,5 điểm)", "2 pts", "-1", "x", None], answers.points) == [0.25, 0.25, 0.5, 1.0, 0.5, 2.0, None, None, None]
    assert values(spark, ["1,5", "-2e3", "−3", "1.000,5", ""], answers.sheet_number) == [1.5, -2000.0, -3.0, None, None]
    assert values(spark, ["1.234,5", "1,234.5", "1.000.000", "1,5", ",5", "1e3"], answers.document_number) == [1234.5, 1234.5, 1000000.0, 1.5, 0.5, None]
    got = values(spark, ["12,5 ± 0,1", "3 .. 1", "7.", "x"], answers.numeric_answer)
    assert (got[0].exact, got[0].margin, got[1].min, got[1].max, got[2].exact, got[3]) == (12.5, 0.1, 1.0, 3.0, 7.0, None)
    assert values(spark, ["A, C", "BD", "A và C", "A, Z", ""], answers.option_letters) == [["A", "C"], ["B", "D"], ["A", "C"], None, None]
    assert values(spark, [["-1,5", " -1,5", None], ["Ab", "aB"]], answers.variants, "array<string>") == [["-1,5", "−1,5", "-1.5", "−1.5"], ["Ab"]]


def test_grading_vectors(spark):
    keys = spark.createDataFrame([("i", [0, 1, 2, 3], [0, 1], 2.0)], "item string, options array<int>, correct array<int>, points double")
    said = spark.createDataFrame([(1, "i", [0, 1]), (2, "i", [0]), (3, "i", [0, 2]), (4, "i", [0, 1, 2]), (5, "i", []), (6, "i", [9])], "student int, item string, chosen array<int>")
    assert {r.student: r.score for r in grading.grade_multiple(said, keys).collect()} == {1: 2.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: None, 6: 0.0}
    spans = spark.createDataFrame([("i", 12.4, 12.6, 1.0), ("i", 100.0, 200.0, 1.0)], "item string, low double, high double, points double")
    said = spark.createDataFrame([(1, "i", "12.55"), (2, "i", "12,55"), (3, "i", "12,5"), (4, "i", "150"), (5, "i", " "), (6, "i", "x")], "student int, item string, value string")
    assert {r.student: r.score for r in grading.grade_numeric(said, spans).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 0.0, 6: 0.0}
    accepted = spark.createDataFrame([("i", "Ha Noi", 1.0), ("i", " ", 1.0)], "item string, answer string, points double")
    said = spark.createDataFrame([(1, "i", "  ha NOI "), (2, "i", "ha  noi"), (3, "i", "")], "student int, item string, value string")
    assert {r.student: r.score for r in grading.grade_short(said, accepted).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_keys(spark):
    key = spark.createDataFrame([("e", "", "1", "A"), ("e", "2", "1", "B"), ("f", "3", "1", "C")], "exam string, part string, no string, value string")
    asked = spark.createDataFrame([("e", 1, "2", "1"), ("e", 2, "9", "1"), ("e", 3, "2", "7"), ("f", 4, "", "1"), ("g", 5, "", "1")], "exam string, qid int, part string, no string")
    assert {r.qid: r.value for r in answer_key.find_answers(asked, key).collect()} == {1: "B", 2: "A", 3: None, 4: "C", 5: None}
    marks = spark.createDataFrame([("A", "a."), ("", "A"), ("A", "B"), ("A", "")], "marked string, keyed string")
    assert [r[0] for r in marks.select(answer_key.outcome(F.col("marked"), F.col("keyed"))).collect()] == ["same", "filled", "conflict", "skipped"]
    assert values(spark, [["toan", "huong", "dan", "cham", "key", "12"]], answer_key.base_name_tokens, "array<string>") == [["toan", "12"]]


def test_ordered(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("a", 4, 2), ("a", 5, 2)], "f string, o int, no int")
    assert [r.segment for r in ordered.segments(rows, "no", ["f"], ["o"]).orderBy("o").collect()] == [1, 1, 2, 2, 3]
    marks = spark.createDataFrame([("s", 1, "p"), ("s", 7, "q")], "sheet string, at int, pic string")
    lines = spark.createDataFrame([("s", 3, "r3"), ("s", 5, "r5")], "sheet string, at int, name string")
    assert {r.pic: r.row for r in ordered.nearest_above(marks, lines, ["sheet"], "at", "name", "row").collect()} == {"p": "r3", "q": "r5"}
    split = ordered.equal_split(spark.createDataFrame([("q", i, 1.0) for i in range(3)], "q string, i int, t double"), "t", ["q"], ["i"], "s")
    assert [r.s for r in split.orderBy("i").collect()] == [0.3333, 0.3333, 0.3334]


def test_validation_of_every_type(spark):
    schema = validation.QUESTION
    base = dict(bank="b", pos=1, id="q1", no="1", title="t", points=1.0, stimulus=None, stem="Stem [a]", feedback=None, choices=None, statements=None, answers=None, numeric=None, blanks=None, dropdowns=None, pairs=None, distractors=None)
    good = [
        dict(type="mc", choices=[("A", "x", True), ("B", "y", False)]), dict(type="tf", statements=[("a", "x", True)]), dict(type="short", answers=["x"]),
        dict(type="num", numeric=(1.0, 0.1, None, None)), dict(type="blanks", blanks=[("a", ["x"])]), dict(type="dropdowns", dropdowns=[("a", ["x", "y"], 1)]),
        dict(type="matching", pairs=[("x", "1"), ("y", "2")], distractors=["3"]), dict(type="essay"), dict(type="text", points=None),
    ]
    frame = spark.createDataFrame([base | g | {"pos": i} for i, g in enumerate(good)], schema)
    assert validation.issues(frame).collect() == []
    bad = [dict(type="blanks", stem="none", blanks=[("a", [" "]), ("a", ["<b>x</b>"]), ("1", ["y"])]), dict(type="dropdowns", dropdowns=[("a", ["x", " X", " "], 5)]), dict(type="tf", points=0.0, statements=[("a", "", None), ("a", "x", True)]), dict(type=None)]
    frame = spark.createDataFrame([base | g | {"pos": i} for i, g in enumerate(bad)], schema)
    got = {}
    for r in validation.issues(frame).collect():
        got.setdefault(r.pos, set()).add(r.code)
    assert got == {
        0: {"blank_without_answer", "blank_answer_html", "blanks_id", "blanks_id_twice", "blanks_not_in_stem"},
        1: {"dropdown_undecided", "dropdown_option_empty", "dropdown_option_twice"},
        2: {"points", "statement_undecided", "statement_key_twice", "statement_empty"},
        3: {"type"},
    }


def test_integrity(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 30, 31)], "id int, a_start int, a_end int")
    b = spark.createDataFrame([(7, 9, 40), (8, 10, 12)], "jd int, b_start int, b_end int")
    both = integrity.overlaps(a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1)), ["k"], 4)
    assert sorted((r.id, r.jd) for r in both.collect()) == [(1, 7), (2, 7)]


def test_files(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("__MACOSX/x", "noise")
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Câu hỏi</t></si><si><r><t>Đáp </t></r><r><t>án</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>2+2?</t></is></c><c r="B2"><v>4</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    bad = data.getvalue()[:-30]
    frame = spark.createDataFrame([("a.xlsx", bytearray(data.getvalue())), ("b", bytearray(b"%PDF-1")), ("c", bytearray(bad)), ("d", None)], "archive string, content binary")
    assert {r.archive: r.k for r in frame.select("archive", files.file_kind(F.col("content")).alias("k")).collect()} == {"a.xlsx": "zip", "b": "pdf", "c": "zip", "d": "unknown"}
    members = files.explode_archives(frame)
    got = {(r.archive, r.path, r.error) for r in members.select("archive", "path", "error").collect()}
    assert ("a.xlsx", "xl/workbook.xml", None) in got and ("c", None, "not an archive") in got and not any("MACOSX" in (p or "") for _, p, _ in got)
    assert {r.archive: r.kind for r in files.archive_kind(members.where("error is null")).collect()} == {"a.xlsx": "xlsx"}
    found = sheets.records(files.read_cells(members))
    row = found.first()
    assert (row["content"], row["answer"], found.count()) == ("2+2?", "4", 1)


def test_packages(spark):
    rows = spark.createDataFrame([("b", i) for i in range(3)], "bank string, i int")
    assert [r.ident for r in packages.number_items(rows, "bank", ["i"]).orderBy("i").collect()] == ["b_q01", "b_q02", "b_q03"]
    names = spark.createDataFrame([("p", "b.xml"), ("p", "a&.xml")], "package string, path string")
    assert packages.manifest(names).first().manifest.startswith('<manifest><resources><resource href="a&amp;.xml">')


def test_answers_as_people_write_them(spark):
    assert values(spark, ["A or C", "A hoặc C", "A HOAC C"], answers.option_letters) == [None, ["A", "C"], ["A", "C"]]
    got = values(spark, ["Đáp án: B", "A - C", "A va C", "ĐA. D", "B|C", "x"], lambda c: F.array_join(answers.option_letters(c), ""))
    assert got == ["B", "AC", "AC", "D", "BC", None]
    marks = lambda c: F.to_json(answers.true_false_of(answers.true_false(c), F.array(F.lit("a"), F.lit("b"))))
    assert values(spark, ["ĐS", "b-Đ, a-S", "a) Đúng b) Sai", "a-Đ", "Đúng; Sai", "maybe", ""], marks) == ['{"a":true,"b":false}', '{"b":true,"a":false}', '{"a":true,"b":false}', None, '{"a":true,"b":false}', None, None]
    assert values(spark, ["<p>&#160;</p>", "<b>&#xA0;\u200b</b>", "&amp;"], text.is_blank_html) == [True, True, False]


def test_white_space_and_ranges(spark):
    said = spark.createDataFrame([("s", "i", "Ha Noi\t"), ("t", "i", "\u00a0ha noi\n"), ("u", "i", "Ha  Noi")], "student string, item string, value string")
    keys = spark.createDataFrame([("i", "ha noi", 1.0)], "item string, answer string, points double")
    assert {r.student: r.score for r in grading.grade_short(said, keys).collect()} == {"s": 1.0, "t": 1.0, "u": 0.0}
    q = spark.createDataFrame([("e", 1, "", 21, 22), ("e", 2, "", 23, 24), ("e", 3, "", 25, 26)], "exam string, qid int, part string, low int, high int")
    k = spark.createDataFrame([("e", "", "21", "A"), ("e", "", "22", "C"), ("e", "", "23", "B"), ("e", "", "23-24", "B, D")], "exam string, part string, no string, value string")
    assert {r.qid: r.value for r in answer_key.find_range_answers(q, k).collect()} == {1: "A, C", 2: "B, D", 3: None}
    rows = spark.createDataFrame([("q", 0, 0, "error", "Dòng 12 (Phần II):  thiếu  ý"), ("q", 1, 0, "error", "Thiếu ý")], "q string, source int, ord int, level string, message string")
    assert validation.merge_issues(rows, ["q"]).count() == 1
