"""Package forms read to one schema, answers looked up in their domains, JSON walked to its leaves."""

import json

import pytest

from exalake.operators import domains
from exalake.sources import forms, json_data

PACKAGES = {
    "passages": {
        "EXAM_INFO": {"title": "T"},
        "PASSAGES": [
            {"no": 1, "title": "Bees", "groups": [
                {"type": "choice", "head": "Q1", "opts": [{"k": "A", "t": "one"}, {"k": "B", "t": "two"}], "items": [{"n": 0, "q": "example", "ans": "A"}, {"n": 1, "q": "q1", "ans": "B"}, {"n": 2, "q": "q2", "ans": "C"}]},
                {"type": "select", "list": [{"k": "i", "t": "First"}, {"k": "ii", "t": "Second"}, {"k": "iii", "t": "Third"}], "example": {"ans": "iii"}, "items": [{"n": 3, "q": "Para A", "ans": "i"}, {"n": "4", "q": "Para B", "ans": "ix"}]}]},
            {"no": 2, "groups": [{"type": "multi", "opts": ["a", "b", "c"], "ans": ["A", "D"], "items": [{"n": 5}, {"n": 6}]}]},
        ],
    },
    "keyed": {"EXAM_INFO": {"ptI": 0.25, "ptIII": 0.5}, "PARTS": [{"label": "PHẦN I", "key": "I", "type": "mcq", "items": [{"n": 1, "q": "1 < 2", "opts": ["yes", "no"], "ans": "A"}]}, {"label": "PHẦN III", "key": "III", "type": "short", "items": [{"n": 1, "q": "?", "ans": ["4", "bốn"]}]}]},
    "exercises": {
        "EXAM_INFO": {}, "EXERCISES": [
            {"roman": "I", "no": 1, "instr": "Fill & choose", "type": "bank", "bank": ["in", "O’clock", "at"], "example": {"q": "x", "ans": "at"}, "items": [{"n": 1, "q": "a<b", "ans": "IN", "alt": ["into"]}, {"n": 2, "q": "y", "ans": "o'clock"}, {"n": 3, "q": "z", "ans": "on"}]},
            {"no": 2, "instr": "Find", "type": "mistake", "items": [{"n": 4, "ans": "B", "seg": [{"t": "He "}, {"t": "go", "k": "A"}, {"t": "es", "k": "B"}]}]},
            {"roman": "II", "no": 3, "instr": "Read", "type": "cloze", "text": "t", "items": [{"n": 5, "opts": ["p&q", "r"], "ans": "A"}]},
        ],
    },
    "games": {"EXAM_INFO": {}, "PARTS": [
        {"id": 1, "icon": "x", "title": "Pick", "type": "imageChoice", "items": [{"n": 1, "prompt": "cat", "opts": [{"k": "A", "img": "a.png"}], "ans": "A"}]},
        {"id": 2, "icon": "x", "title": "Tags", "type": "letterMatch", "bank": [{"v": "A", "t": "to"}, {"v": "B", "t": "<at>", "example": True}, {"v": "C", "t": "by"}], "items": [{"n": 2, "prompt": "p", "ans": "C"}]},
        {"id": 3, "icon": "x", "title": "Order", "type": "order", "items": [{"n": 3, "prompt": "p", "cue": "be", "chunks": [{"id": "c1", "t": "I"}, {"id": "c2", "t": "am"}, {"id": "c3", "t": "!"}], "target": ["c1", "c2", "c3"]}]},
        {"id": 4, "icon": "x", "title": "Sure", "type": "yesno", "items": [{"n": 4, "prompt": "p", "ans": "NO"}]},
        {"id": 5, "icon": "x", "title": "New", "type": "dance", "items": []}]},
    "math": {"QUESTIONS": [{"n": 1, "type": "choice", "prompt": "2+2", "options": ["3", "4"], "answer": "4"}, {"n": 2, "type": "choice", "prompt": "2+3", "options": ["3", "4"], "answer": "5"}, {"n": 3, "type": "type", "prompt": "1+1", "answer": "2"}]},
    "template": {"EXAM": {"title": "x"}, "PARTS": [{"label": "I", "groups": [{"type": "letters", "keys": ["A", "B", "C"], "exampleKey": "A", "perItem": 0.5, "items": [{"n": 1, "q": "s", "ans": "B"}]}, {"type": "riddle", "items": [{"n": 2, "ans": "?"}]}]}]},
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, json.dumps(v, ensure_ascii=False), 1) for k, v in PACKAGES.items()] + [("none", None, 0), ("bad", "{", 0), ("odd", '{"a": 1}', 0), (None, json.dumps(PACKAGES["math"]), 0)]
    return spark.createDataFrame(rows, "package string, data string, v int")


def test_forms(read):
    rows = sorted(forms.items(forms.groups(read.where("package IS NOT NULL"))).collect(), key=lambda r: (r.package, r.part, r.grp, r.item))
    got = {p: [(r.part, r.grp, r.label, r.type, r.no, r.stem, r.answers, r.points) for r in rows if r.package == p] for p in PACKAGES}
    assert got["passages"][:2] == [(0, 0, "READING PASSAGE 1", "mcq", "1", "q1", ["B"], 1.0), (0, 0, "READING PASSAGE 1", "mcq", "2", "q2", ["C"], 1.0)] and len(got["passages"]) == 6
    assert got["keyed"] == [(0, 0, "PHẦN I", "mcq", "1", "1 < 2", ["A"], 0.25), (1, 0, "PHẦN III", "short", "1", "?", ["4", "bốn"], 0.5)]
    assert [x[:6] for x in got["exercises"]] == [(0, 0, "I", "bank", "1", "a&lt;b"), (0, 0, "I", "bank", "2", "y"), (0, 0, "I", "bank", "3", "z"), (0, 1, "I", "mistake", "4", ""), (1, 0, "II", "mcq", "5", "")]
    assert got["exercises"][0][6] == ["IN", "into"]
    assert [x[2:] for x in got["games"]] == [("Chặng 1: Pick", "mcq", "1", "<b>cat</b>", ["A"], 1.0), ("Chặng 2: Tags", "letters", "2", "p", ["C"], 1.0), ("Chặng 3: Order", "order", "3", "p <b>(be)</b>", ["I am!"], 2.0), ("Chặng 4: Sure", "mcq", "4", "p", ["NO"], 1.0)]
    assert [(x[1], x[3], x[6]) for x in got["math"]] == [(0, "mcq", ["B"]), (1, "mcq", ["UNMATCHED:5"]), (2, "short", ["2"])]
    assert [(x[3], x[7]) for x in got["template"]] == [("letters", 0.5), ("riddle", None)]
    heads = {(r.package, r.part, r.grp): r for r in forms.groups(read).collect()}
    assert heads["exercises", 0, 0].head == "1. Fill &amp; choose" and heads["games", 4, 0].type == "UNKNOWN:dance" and heads["games", 1, 0].example_key == "B"
    assert [tuple(o) for o in heads["exercises", 0, 1]["items"][0].options] == [("A", "go"), ("B", "es")] and (None, 0, 0) in heads
    assert {r.package: r.why for r in forms.unread(read).collect()} == {"none": "no data", "bad": "broken", "odd": "unknown form"}
    assert forms.groups(read.where("package = 'x'")).collect() == []


def test_hidden_answers(spark):
    import base64

    table = json.dumps(["B", "bánh"]).encode()
    hidden = base64.b64encode(bytes(b ^ ord("key"[i % 3]) ^ (i * 31 & 255) for i, b in enumerate(table))).decode()
    data = {"EXAM": {}, "_KX": hidden, "_KM": "key", "PARTS": [{"label": "I", "groups": [{"type": "mcq", "opts": ["x", "y"], "items": [{"n": 1, "ans": 0}, {"n": 2, "ans": 7}, {"n": 3, "ans": "1"}]}]}]}
    frame = spark.createDataFrame([("p", json.dumps(data))], "package string, data string")
    assert [r.answers for r in sorted(forms.items(forms.groups(frame)).collect(), key=lambda r: r.no)] == [["B"], [None], ["1"]]


def test_domains(read):
    got = {(r.package, r.part, r.grp, r.item, r.ask, r.domain, r.answer, r.by, r.place, r.text, r.state) for r in domains.resolve(forms.groups(read.where("package IS NOT NULL"))).collect()}
    of = lambda *key: {x[len(key) :] for x in got if x[: len(key)] == key}
    # a choice by its key; by the letter of its place; none
    assert (0, "option", "B", 0, 1, "two", "resolved") in of("passages", 0, 0, 1) and (0, None, "C", None, None, None, "unresolved") in of("passages", 0, 0, 2)
    assert of("passages", 0, 1) == {(0, 0, "heading", "i", 0, 0, "First", "resolved"), (1, 0, None, "ix", None, None, None, "unresolved"), (-1, None, "heading", None, None, 1, "Second", "unused"), (-1, None, "heading", None, None, 2, "Third", "example")}
    assert {x[2:] for x in of("passages", 1, 0)} == {("option", "A", 0, 0, "a", "resolved"), (None, "D", None, None, None, "unresolved"), ("option", None, None, 1, "b", "unused"), ("option", None, None, 2, "c", "unused")}
    # words without regard to case and apostrophes; that of the worked example is not left over
    assert {(x[2], x[3], x[5], x[7]) for x in of("exercises", 0, 0)} == {("word", "IN", 0, "resolved"), ("word", "o'clock", 1, "resolved"), (None, "on", None, "unresolved"), ("word", None, 2, "example")}
    assert (0, "option", "B", 0, 1, "es", "resolved") in of("exercises", 0, 1, 0)
    assert {(x[2], x[6], x[7]) for x in of("games", 1, 0)} == {("person", "by", "resolved"), ("person", "&lt;at&gt;", "example"), ("person", "to", "unused")}
    assert (0, None, "UNMATCHED:5", None, None, None, "unresolved") in of("math", 0, 1, 0)
    assert not of("math", 0, 2) and not of("template", 0, 1)
    assert domains.resolve(forms.groups(read.where("package = 'x'"))).collect() == []


def test_place_stands_in_for_key(spark):
    data = {"EXAM": {}, "PARTS": [{"label": "I", "groups": [{"type": "mcq", "opts": [{"k": "X", "t": "x"}, {"k": "A", "t": "a"}, {"k": "A", "t": "again"}], "items": [{"n": 1, "ans": "A"}, {"n": 2, "ans": "B"}, {"n": 3}]}]}]}
    frame = spark.createDataFrame([("p", json.dumps(data))], "package string, data string")
    rows = {(r.item, r.answer, r.domain, r.by, r.place) for r in domains.resolve(forms.groups(frame)).collect() if r.state in ("resolved", "unresolved")}
    assert rows == {(0, "A", "option", 0, 1), (1, "B", "place", 1, 1), (2, None, None, None, None)}


def test_leaves(spark):
    texts = ['{"a": [1, {"b c": "x\\"y[{", "d": null}], "e": {}, "f": [[]], "g": true}', '"alone"', None, "", "{broken", '[[["deep"]]]', '{"it\'s": {"k": 1.5}}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, path_of string")
    got = sorted((r.id, r.path, r.kind, r.text) for r in json_data.leaves(frame, "path_of").collect())
    assert got == sorted([(0, "$.a[0]", "number", "1"), (0, "$.a[1]['b c']", "string", 'x"y[{'), (0, "$.a[1].d", "null", None), (0, "$.e", "object", None), (0, "$.f[0]", "array", None), (0, "$.g", "boolean", "true"), (1, "$", "string", "alone"), (5, "$[0][0][0]", "string", "deep"), (6, "$['it\\'s'].k", "number", "1.5")])
    assert json_data.leaves(frame.where("id > 99"), "path_of").collect() == []
