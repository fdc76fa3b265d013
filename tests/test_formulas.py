"""Formulas against a reader from left to right."""

import random
import re

import pytest

from exalake.operators import formulas
from exalake.operators.formulas import INNER_TAGS, MARKUP, SIGN


def plain(text, html):
    tags = [m[0] for m in re.finditer(MARKUP, text)] if html else []
    s = re.sub(MARKUP, SIGN, text) if html else text
    out, i = [], 0

    def take(start, close, wide, display):
        content = s[start + wide : close]
        before = s[: start + wide].count(SIGN)
        held = tags[before : before + content.count(SIGN)]
        tex = content.replace(SIGN, "")
        for a, b in (("&lt;", "<"), ("&amp;", "&")) if html else ():
            tex = tex.replace(a, b)
        if not tex.strip() or any(re.match(r"</?([A-Za-z][A-Za-z0-9:-]*)", t) is None or re.match(r"</?([A-Za-z][A-Za-z0-9:-]*)", t)[1].lower() not in INNER_TAGS for t in held):
            return False
        opens, closes = [], []
        for t in held:
            if t.endswith("/>"):
                continue
            name = re.match(r"</?([A-Za-z0-9:-]*)", t)[1]
            same = [k for k, o in enumerate(opens) if re.match(r"<([A-Za-z0-9:-]*)", o)[1] == name]
            if not t.startswith("</"):
                opens.append(t)
            elif same:
                opens.pop(same[-1])
            else:
                closes.append(t)
        out.append((start, close + wide, tex, display, "".join(closes), "".join(opens)))
        return True

    while i < len(s):
        if s[i] == "\\":
            if s[i + 1 : i + 2] in ("(", "["):
                e = s.find("\\)" if s[i + 1] == "(" else "\\]", i + 2)
                if e > 0 and take(i, e, 2, s[i + 1] == "["):
                    i = e + 2
                    continue
            i += 2
        elif s[i] == "$":
            double = s[i + 1 : i + 2] == "$"
            wide = 1 + double
            j, end = i + wide, -1
            while j < len(s):
                if s[j] == "\\":
                    j += 2
                    continue
                if s[j] == "$" and (not double or s[j + 1 : j + 2] == "$"):
                    end = j
                    break
                j += 1
            ok = end > i + wide and (double or not (s[i + 1].isspace() or s[end - 1].isspace() or s[end + 1 : end + 2].isdigit()))
            i = end + wide if ok and take(i, end, wide, double) else i + wide
        else:
            i += 1
    return out


@pytest.mark.parametrize("html", [False, True])
def test_formulas_equal_a_reader(spark, html):
    rng = random.Random(11 + html)
    atoms = ["$", "$", "$", "$$", "\\", "\\(", "\\)", "\\[", "\\]", " ", "x", "é", "5", "\n", "y^2"] + (["<b>", "</b>", "<i>", "</i>", "<p>", "<br/>", "<!-- $ -->", "<math>$</math>", "&lt;", "<sub/>"] if html else [])
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(26))) for _ in range(700)] + ["", "$a$ " * 60, "5$ và 10$ và $x$5"]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "$x$", 1), (None, "$x$", 1), (9999, None, 1)], "id int, text string, at int")
    got = {}
    for r in formulas.formulas(frame, ["id"], "text", html).collect():
        got.setdefault(r.id, []).append((r.start, r.stop, r.tex, r.display, r.closes, r.opens))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(t, html), t
    assert got[None] == [(0, 3, "x", False, "", "")]
    assert formulas.formulas(frame.where("id < 0"), ["id"], "text", html).collect() == []


def test_known_cases(spark):
    texts = ["Cho $x^2$ và \\(y\\).", "Tính $$\\int_0^1 x\\,dx$$.", "Giá \\$5 và $a<b$", "Từ $5 tới $10", "$ x $", "$\\$$", "\\(a\\) và \\(b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in formulas.formulas(frame, ["id"], "text").orderBy("id", "start").collect():
        got.setdefault(r.id, []).append(r.tex)
    assert got == {0: ["x^2", "y"], 1: ["\\int_0^1 x\\,dx"], 2: ["a<b"], 5: ["\\$"], 6: ["a"]}
    pages = ["<p>Cho $x &lt; <em>y</em>$ và <b>đậm</b></p>", "<p>Cho $x <em>y$ z</em> w</p>", "<p><em>a $b</em> c$ d</p>", "<p>$a</p><p>b$</p>", "<math><mi>$</mi></math> và $y$"]
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, text string")
    got = {r.id: (r.tex, r.closes, r.opens) for r in formulas.formulas(frame, ["id"], "text", html=True).collect()}
    assert got == {0: ("x < y", "", ""), 1: ("x y", "", "<em>"), 2: ("b c", "</em>", ""), 4: ("y", "", "")}
