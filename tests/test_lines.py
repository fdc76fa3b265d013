"""Merged cells, running context, chains of labels and scripts against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from exalake.operators import context, regions, successors
from exalake.sources import scripts


# -- merged cells ----------------------------------------------------------------------------------------------------------
def test_merged_cells_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    sheets = [(rng.choice(["a", "b"]), rng.randrange(200), rng.randrange(12), rng.choice(["", " ", None, "x", "y"])) for _ in range(1500)]
    sheets = list({x[:3]: x for x in sheets}.values())
    boxes = []
    for i in range(120):
        r, c = rng.randrange(190), rng.randrange(10)
        boxes.append((rng.choice(["a", "b", "c"]), r, c, r + rng.choice([0, 1, 5, 60, 150]), c + rng.choice([0, 1, 4]), i // 2))
    boxes += [("a", 0, 0, 1 << 20, 1 << 13, 999), ("a", 5, 5, 4, 5, 0), ("a", None, 0, 3, 3, 0)]
    cells = spark.createDataFrame(sheets, "sheet string, r int, c int, text string")
    frame = spark.createDataFrame(boxes, "sheet string, r1 int, c1 int, r2 int, c2 int, o int")
    wanted = F.coalesce(F.trim("text"), F.lit("")) == ""
    corner = {x[:3]: x[3] for x in sheets}

    def plain(s, r, c, text):
        if (text or "").strip():
            return None
        inside = [(o, r1, c1) for t, r1, c1, r2, c2, o in boxes if t == s and r1 is not None and r1 <= r <= r2 and c1 <= c <= c2 and (r, c) != (r1, c1)]
        return corner.get((s, *min(inside)[1:])) if inside else None

    for levels in ({"r": 12, "c": 6}, {"r": 3, "c": 1}):
        monkeypatch.setattr(regions, "MOST_LEVEL", levels)
        few = frame.where("o < 999") if levels["r"] == 3 else frame
        if levels["r"] == 3:
            boxes = [b for b in boxes if b[5] < 999]
        got = regions.anchor_values(cells, few, ["sheet"], "text", "o", wanted, "value")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*x, plain(*x)) for x in sheets), key=repr)
    assert regions.anchor_values(cells.where("r < 0"), frame, ["sheet"], "text", "o", wanted, "value").collect() == []
    assert {r.value for r in regions.anchor_values(cells, frame.where("o < 0"), ["sheet"], "text", "o", wanted, "value").collect()} == {None}


# -- context ----------------------------------------------------------------------------------------------------------------
ORDER = ["bank", "part", "passage", "group"]


def plain_context(rows):
    out = []
    for d in {r[0] for r in rows}:
        opened, reset, seen = {}, {}, {}
        for _, i, k in [r for r in rows if r[0] == d]:
            if k in ORDER:
                j = ORDER.index(k)
                for x in ORDER[j:]:
                    opened.pop(x, None)
                for x in ORDER[j + 1 :]:
                    reset[x] = seen.get(x, 0)
                seen[k] = seen.get(k, 0) + 1
                opened[k] = (f"{k}{i}", seen[k] - reset.get(k, 0), seen.get("q", 0))
            if k == "end":
                opened.pop("passage", None)
            if k == "points":
                seen[k] = seen.get(k, 0) + 1
                opened[k] = (i, seen[k], seen.get("q", 0))
            if k == "q":
                seen["q"] = seen.get("q", 0) + 1
            row = [d, i, k, f"{k}{i}"]
            for x in [*ORDER, "points"]:
                row += [opened[x][0], opened[x][1], seen.get("q", 0) - opened[x][2]] if x in opened else [None] * 3
            out.append(tuple(row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_context_equals_plain_one(spark, block):
    rng = random.Random(2)
    rows = [(d, i, rng.choice([*ORDER, "end", "points", "q", "q", "q", None])) for d in (1, 2, None) for i in range(60)]
    frame = spark.createDataFrame([(d, i, k, f"{k}{i}") for d, i, k in rows], "doc int, line int, kind string, v string")
    of = lambda k: F.col("kind") == k
    scopes = [context.Scope(k, of(k), F.col("v"), of("end") if k == "passage" else None) for k in ORDER] + [context.Scope("points", of("points"), F.col("line"), keeps=True)]
    assert sorted(map(tuple, context.running_context(frame, ["doc"], "line", scopes, of("q"), block).collect()), key=repr) == plain_context(rows)
    assert context.running_context(frame.where("line < 0"), ["doc"], "line", scopes, of("q"), block).collect() == []


# -- labels -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("block", "labels"), [(1 << 16, 6), (4, 6), (9, 40), (1, 2)])
def test_chains_equal_plain_ones(spark, block, labels):
    rng = random.Random(labels)
    rows = [(d, i, rng.choice([*range(labels + 1), None]) if labels < 40 else i // 2 + rng.randrange(2)) for d in (1, 2, None) for i in range(90)] + [(3, 0, 2), (3, 1, 1), (3, 1, 2), (3, 2, 2), (4, None, 1)]
    want = set()
    for d in (1, 2, None, 3):
        last, at = 0, -1
        for _, i, n in sorted((r for r in rows if r[0] == d and r[1] is not None), key=lambda r: r[1]):
            if n == last + 1 and i > at:
                want.add((d, i, n))
                last, at = n, i
    frame = spark.createDataFrame(rows, "doc int, line int, n int")
    got = successors.accepted(frame, ["doc"], "line", "n", block=block).collect()
    assert len(got) == len(rows) and {(r.doc, r.line, r.n) for r in got if r.accepted} == want and len(want) > 3
    assert successors.accepted(frame.where("line < 0"), ["doc"], "line", "n").collect() == []


# -- scripts ----------------------------------------------------------------------------------------------------------------
def plain_blocks(s):
    out, open_, i = [], [], 0
    while i < len(s):
        if s.startswith("/*", i) and s.find("*/", i + 2) >= 0:
            i = s.find("*/", i + 2) + 2
            continue
        if s.startswith("//", i):
            i = s.find("\n", i) if s.find("\n", i) >= 0 else len(s)
            continue
        if s[i] in "\"'`" and s.find(s[i], i + 1) >= 0:
            i = s.find(s[i], i + 1) + 1
            continue
        if s[i] == "{":
            open_.append(i)
        elif s[i] == "}" and open_:
            out.append((open_[-1], i, len(open_)))
            open_.pop()
        i += 1
    return sorted(out + [(a, None, n + 1) for n, a in enumerate(open_)])


def test_blocks_equal_plain_ones(spark):
    rng = random.Random(9)
    atoms = ["{", "{", "}", "}", '"', "'", "`", "/*", "*/", "//", "\n", "x", " é", "function f(", "/"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {}
    for r in scripts.blocks(scripts.tokens(frame, ["id"], "body"), ["id"]).collect():
        got.setdefault(r.id, []).append((r.open, r.close, r.depth))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=lambda x: x[0]) == sorted(plain_blocks(t or ""), key=lambda x: x[0]), t


def test_functions_and_regions(spark):
    body = 'var a = "function no() {"; // function no2() {\nfunction one(x) { if (x) { return "\\"}"; } /* } */ return {}; }\nfunction $two () { `}` }\nfunction open() { {'
    html = f"<p><script src='x.js'></script><SCRIPT type=a>{body}</SCRIPT><script>var PARTS = [1];</script>"
    found = scripts.inline_scripts(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), ["page"], "html")
    assert [(r.script, r.body) for r in found.orderBy("script").collect()] == [(1, body), (2, "var PARTS = [1];")]
    got = {r.name: r.source for r in scripts.functions(found, ["page", "script"], "body").collect()}
    assert got == {"one": 'function one(x) { if (x) { return "\\"}"; } /* } */ return {}; }', "$two": "function $two () { `}` }", "open": None}
    marked = "top /* === PHẦN 1/2: edit === */ var EXAM = {}; /* HẾT PHẦN SỬA. PHẦN 2/2 */ rest"
    texts = [marked, "let QUESTIONS = [];\n  var SCORM = 1;", "var EXAM = 1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scripts.data_region(F.col("t")).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in rows] == [(" var EXAM = {}; ", "marks"), ("let QUESTIONS = [];\n", "before"), None, None]


# -- names, pictures, messages -------------------------------------------------------------------------------------------------
def test_names_pass_over_given_ones(spark):
    from exalake.operators import ordered

    names = ["x", "X", "x_2", "x", "x_2", "y_02", "y", "Y", "x_4", None]
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 0, "x"), (2, 1, "x"), (None, 0, "z"), (None, 1, "z"), (None, 2, "z_2")], "bank int, i int, name string")
    got = {(r.bank, r.i): r.out for r in ordered.unique_names(frame, "name", ["bank"], ["i"], "out").collect()}
    assert [got[1, i] for i in range(10)] == ["x", "X_3", "x_2", "x_5", "x_2_2", "y_02", "y", "Y_2", "x_4", None]
    assert [got[2, 0], got[2, 1], got[None, 0], got[None, 1], got[None, 2]] == ["x", "x_2", "z", "z_3", "z_2"]


def test_pictures_of_formulas_are_left_out(spark):
    from exalake.operators import exports

    html = '<img class="equation_image" src="/equation_images/x"><img src="/equation_images/y"><img class=a src="z.png"><img src="data:x">'
    fragments = spark.createDataFrame([("b", 1, html)], "bank string, id int, html string")
    images = spark.createDataFrame([], "bank string, name string, kind string")
    assert {(r.code, r.name) for r in exports.image_issues(fragments, images).collect()} == {("outside", "/equation_images/y"), ("outside", "z.png"), ("data_uri", "data:x")}


def test_only_question_leads_are_taken_off(spark):
    from exalake.operators import validation

    rows = [("q", 0, i, "error", m) for i, m in enumerate(["Câu 3: no stem", "Question 4 (II): No  stem", "Row 3: no stem", "Hàng 3: no stem", "row 3: no stem"])]
    got = validation.merge_issues(spark.createDataFrame(rows, "q string, source int, ord int, level string, message string"), ["q"])
    assert {r.message for r in got.collect()} == {"Câu 3: no stem", "Row 3: no stem", "Hàng 3: no stem"}
