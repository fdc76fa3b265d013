"""Items written and read back: what they accept is what the question says."""

import random

from pyspark.sql import functions as F

from exalake.operators import items, validation

NAMES = {"mc": "multiple_choice_question", "ma": "multiple_answers_question"} | items.ITEM_TYPES


def made_up(n):
    rng = random.Random(5)
    words = ["x", "a < b", "Tom & Jerry", '"q"', "é", "<b>bold</b>", "<p>2 &lt; 3</p>", "y's", "12", "−3"]
    word = lambda: rng.choice(words) + str(rng.randrange(1000))
    plain = lambda: rng.choice([w for w in words if "<p>" not in w]) + str(rng.randrange(10000))
    rows, want = [], {}
    for i in range(1, n + 1):
        kind = rng.choice(list(items.ITEM_TYPES))
        row = {"bank": "b", "pos": i, "id": str(i), "type": kind, "points": rng.choice([1.0, 0.25, 2.5, 0.3333]), "stem": word(), "title": word(), "feedback": rng.choice([None, "", "<p></p>", "vì <b>thế</b>"])}
        accepted = []
        if kind in ("mc", "ma"):
            texts = list(dict.fromkeys(plain() for _ in range(rng.randint(2, 5))))
            right = [rng.randrange(len(texts))] if kind == "mc" else [k for k in range(len(texts)) if k == 0 or rng.random() < 0.5]
            row["choices"] = [("A", t, k in right) for k, t in enumerate(texts)]
            accepted = [("response1", texts[k], None) for k in right]
        elif kind == "short":
            row["answers"] = [plain() for _ in range(rng.randint(1, 3))]
            accepted = [("response1", a, None) for a in row["answers"]]
        elif kind == "num":
            row["numeric"] = rng.choice([(0.3, 0.1, None, None), (5.0, 0.0, None, None), (None, None, -1.5, 2.0), (1e-7, None, None, None), (1e22, 0.0, None, None)])
            accepted = {0.3: [("0.3",), ("0.2..0.4",)], 5.0: [("5",)], None: [("-1.5..2",)], 1e-7: [("0.0000001",)], 1e22: [("1" + "0" * 22,)]}[row["numeric"][0]]
            accepted = [("response1", *v, None) for v in accepted]
        elif kind in ("blanks", "dropdowns"):
            boxes = [(f"b{k}", [plain() for _ in range(rng.randint(1, 3))]) for k in range(rng.randint(1, 6))]
            at = [0 if kind == "blanks" else rng.randrange(len(o)) for _, o in boxes]
            row[kind] = [(b, o) if kind == "blanks" else (b, o, k) for (b, o), k in zip(boxes, at)]
            accepted = [("response_" + b, o[k], float(f"{100 / len(boxes):.2f}")) for (b, o), k in zip(boxes, at)]
        elif kind == "matching":
            n_pairs = rng.choice([2, 3, 52])
            row["pairs"] = [(f"l{k}", f"r{(k * 7) % n_pairs}") for k in range(n_pairs)]
            row["distractors"] = ["none"]
            base = i * 10000 if n_pairs > 49 else i * 100
            accepted = [(f"response_{base + k + 1}", r, float(f"{100 / n_pairs:.2f}")) for k, (_, r) in enumerate(row["pairs"])]
        rows.append(row)
        want[f"q{i}"] = (items.ITEM_TYPES[kind], 0.0 if kind == "text" else row["points"], accepted)
    return rows, want


def frame(spark, rows):
    names = [f.name for f in spark.createDataFrame([], validation.QUESTION).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], validation.QUESTION).withColumn("ident", F.concat(F.lit("q"), F.col("pos").cast("string")))


def test_items_accept_what_questions_say(spark):
    rows, want = made_up(150)
    xml = frame(spark, rows).select("ident", items.item_of().alias("xml"))
    got = {r.ident: (r.type, r.points, [tuple(a) for a in r.accepted or []]) for r in items.accepted(items.parsed(xml)).collect()}
    assert got == want
    assert items.item_issues(xml, ["ident"]).collect() == []
    assert items.item_issues(xml.where("ident = ''"), ["ident"]).collect() == []


def test_true_false_is_split(spark):
    rows = [{"bank": "b", "pos": 7, "id": "7", "type": "tf", "points": 1.0, "stem": "s", "title": "T", "statements": [("a", "one", True), ("b", "two", False), ("c", "three", True)]}, {"bank": "b", "pos": 8, "id": "8", "type": "essay", "points": 2.0, "title": "T"}]
    xml = items.split_true_false(frame(spark, rows)).select("ident", items.item_of().alias("xml"))
    got = {r.ident: (r.points, [a.value for a in r.accepted]) for r in items.accepted(items.parsed(xml)).collect()}
    assert got == {"q7_s1": (0.3333, ["Đúng"]), "q7_s2": (0.3333, ["Sai"]), "q7_s3": (0.3334, ["Đúng"]), "q8": (2.0, [])}


def test_material(spark):
    cases = {"a < b": ("plain", "a < b"), "<p>2 &lt; 3</p>": ("plain", "2 < 3"), "<p><br/> x&nbsp;y </p>": ("plain", "x y"), "<div><p>plain</p></div>": ("html", "<div><p>plain</p></div>"), "<b>x</b>": ("html", "<b>x</b>"), "x &amp; y": ("plain", "x & y"), "<p>a</p><p>&lt;</p>": ("html", "<p>a</p><p>&lt;</p>")}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", F.from_xml(items.material(F.col("h")), "mattext struct<_VALUE:string,_texttype:string>").alias("m")).collect()
    assert {r.h: (r.m.mattext._texttype.removeprefix("text/"), r.m.mattext._VALUE) for r in rows} == cases


def test_issues(spark):
    rows, _ = made_up(40)
    good = frame(spark, [r for r in rows if r["type"] == "dropdowns"][:1]).select("ident", items.item_of().alias("xml")).first().xml
    label = good[good.index('<response_label ident="') :][23:].split('"')[0]
    cases = {"fine": good, "cut": good[:-9], "null": None, "dangling": good.replace(f'<response_label ident="{label}"', '<response_label ident="1"'), "typed": good.replace("multiple_dropdowns_question", "odd"), "shares": good.replace("</setvar>", "9</setvar>", 1).replace("100.009", "90.00"), "unpaid": good.replace("setvar", "novar")}
    got = {}
    for r in items.item_issues(spark.createDataFrame(list(cases.items()), "name string, xml string"), ["name"]).collect():
        got.setdefault(r.name, set()).add(r.code)
    assert "fine" not in got and got["cut"] == got["null"] == {"not_well_formed"} and got["typed"] == {"unknown_type"} and got["unpaid"] == {"earns_nothing"}
    assert "dangling" in got["dangling"] or "label_twice" in got["dangling"]
    assert got["shares"] & {"shares", "share_form"}
