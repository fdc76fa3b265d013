"""Items of a package as XML with their response processing, and read back: what answers an item accepts, what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.functions.cells import decode_entities, numeric_bounds, right_sides
from exalake.functions.text import WHITE, escape_attribute, escape_xml, has_tag, is_blank_html, occurrences
from exalake.operators.packages import answer_id
from exalake.sources.shared import cut

#: What each question type is called in a package (fixed values).
ITEM_TYPES = {
    "mc": "multiple_choice_question", "ma": "multiple_answers_question", "short": "short_answer_question", "num": "numerical_question", "blanks": "fill_in_multiple_blanks_question",
    "dropdowns": "multiple_dropdowns_question", "matching": "matching_question", "essay": "essay_question", "text": "text_only_question",
}
#: Sides of a matching question beyond this number get wider identities.
NARROW = 49


# -- writing ---------------------------------------------------------------------------------------------------------------
def _el(name: str, attributes: dict[str, Column | str] | None, *children: Column | str) -> Column:
    """An element; attributes in the order given, children as they are."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    said = [p for k, v in (attributes or {}).items() for p in (F.lit(f' {k}="'), escape_attribute(lit(v)), F.lit('"'))]
    return F.concat(F.lit(f"<{name}"), *said, F.lit(">"), *[F.coalesce(lit(c), F.lit("")) for c in children], F.lit(f"</{name}>"))


def _each(array: Column, one) -> Column:
    return F.array_join(F.transform(array, one), "")


def number_text(x: Column) -> Column:
    """A number with a decimal point, without an exponent and trailing zeros; up to 20 places."""
    exact = x.cast("double").try_cast("decimal(38,20)")
    digits = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(exact.cast("double") == x, F.when(digits == "-0", "0").otherwise(digits)).otherwise(F.format_string("%.0f", x.cast("double")))


def text_alone(html: Column) -> Column:
    """The plain text of HTML that is text in bare wrappers alone and has a sign that would be shown escaped; else null."""
    ends = r"(?i)^(?:\s|<br\s*/?>)+|(?:\s|<br\s*/?>)+$"
    wrapper = r"(?is)^<(p|div|span)>(.*)</\1>$"
    start = F.regexp_replace(html, ends, "")
    inner = F.aggregate(F.sequence(F.lit(0), occurrences(start, F.lit("</"))), start, lambda s, _: F.when(s.rlike(wrapper), F.regexp_replace(F.regexp_extract(s, wrapper, 2), ends, "")).otherwise(s))
    text = decode_entities(F.replace(inner, F.lit("&nbsp;"), F.lit(" ")))
    return F.when(~has_tag(inner) & text.rlike("[&<> ]"), F.trim(F.regexp_replace(text, f"{WHITE}+", " ")))


def _plain(text: Column) -> Column:
    return _el("material", None, _el("mattext", {"texttype": "text/plain"}, escape_xml(text)))


def _html(html: Column) -> Column:
    return _el("material", None, _el("mattext", {"texttype": "text/html"}, escape_xml(html)))


def material(html: Column) -> Column:
    """Plain text where there is no markup, or none but text; else HTML."""
    marked = has_tag(html) | html.rlike("&(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    alone = text_alone(html)
    return F.when(~marked, _plain(html)).when(alone.isNotNull(), _plain(alone)).otherwise(_html(html))


def _label(ident: Column, content: Column) -> Column:
    return _el("response_label", {"ident": ident.cast("string")}, content)


def _equal(response: Column | str, value: Column) -> Column:
    return _el("varequal", {"respident": response}, escape_xml(value.cast("string")))


def _condition(going_on: str | None, test: Column, *then: Column) -> Column:
    return _el("respcondition", {"continue": going_on} if going_on else None, _el("conditionvar", None, test), *then)


def _set_all() -> Column:
    return _el("setvar", {"action": "Set", "varname": "SCORE"}, "100")


def _add(share: Column) -> Column:
    return _el("setvar", {"varname": "SCORE", "action": "Add"}, share)


def _choices(kind: str, pos: Column) -> tuple[Column, Column, Column]:
    """(identities, interaction, processing) of mc and ma."""
    ident = lambda i: answer_id(pos, i + 1)
    labels = _each(F.col("choices"), lambda c, i: _label(ident(i), material(c["html"])))
    shown = _el("response_lid", {"ident": "response1", "rcardinality": "Single" if kind == "mc" else "Multiple"}, _el("render_choice", None, labels))
    right = F.coalesce(F.array_position(F.transform("choices", lambda c: F.coalesce(c["correct"], F.lit(False))), True), F.lit(0))
    if kind == "mc":
        test = _equal("response1", answer_id(pos, right))
    else:
        one = lambda c, i: F.when(F.coalesce(c["correct"], F.lit(False)), _equal("response1", ident(i))).otherwise(_el("not", None, _equal("response1", ident(i))))
        test = _el("and", None, _each(F.col("choices"), one))
    return F.transform("choices", lambda c, i: ident(i)), shown, _condition("No", test, _set_all())


def _written(fib: dict | None, label: dict) -> Column:
    return _el("response_str", {"ident": "response1", "rcardinality": "Single"}, _el("render_fib", fib, _el("response_label", label)))


def _short(pos: Column) -> tuple[Column, Column, Column]:
    test = _each(F.col("answers"), lambda a: _equal("response1", a))
    return F.transform("answers", lambda a, i: answer_id(pos, i + 1)), _written(None, {"ident": "answer1", "rshuffle": "No"}), _condition("No", test, _set_all())


def _numeric(pos: Column) -> tuple[Column, Column, Column]:
    numeric, bounds = F.col("numeric"), numeric_bounds(F.col("numeric"))
    between = F.concat(_el("vargte", {"respident": "response1"}, number_text(bounds["low"])), _el("varlte", {"respident": "response1"}, number_text(bounds["high"])))
    near = F.when(F.coalesce(numeric["margin"] > 0, F.lit(False)), _el("and", None, between)).otherwise("")
    test = F.when(numeric["exact"].isNotNull(), _el("or", None, _equal("response1", number_text(numeric["exact"])), near)).otherwise(between)
    return F.array(answer_id(pos, F.lit(1))), _written({"fibtype": "Decimal"}, {"ident": "answer1"}), _condition("No", test, _set_all())


def _boxes(kind: str, pos: Column) -> tuple[Column, Column, Column]:
    """Blanks and lists to choose from: a response for each box; each box adds its share."""
    column = F.col(kind)
    shown = lambda o: o["accepts"] if kind == "blanks" else o["options"]
    right = lambda o: F.lit(0) if kind == "blanks" else F.coalesce(o["correct"], F.lit(0))
    before = lambda i: F.aggregate(F.slice(column, F.lit(1), i), F.lit(0), lambda n, o: n + F.size(shown(o)))
    ident = lambda i, k: answer_id(pos, before(i) + k + 1)
    one = lambda o, i: _el("response_lid", {"ident": F.concat(F.lit("response_"), o["id"]), "rcardinality": "Single"}, _el("material", None, _el("mattext", None, escape_xml(o["id"]))), _el("render_choice", None, _each(shown(o), lambda t, k: _label(ident(i, k), _plain(t)))))
    share = F.format_string("%.2f", F.lit(100.0) / F.greatest(F.size(column), F.lit(1)))
    test = lambda o, i: _condition(None, _equal(F.concat(F.lit("response_"), o["id"]), ident(i, right(o))), _add(share))
    total = F.aggregate(column, F.lit(0), lambda n, o: n + F.size(shown(o)))
    idents = F.when(total > 0, F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda k: answer_id(pos, k)))
    return F.coalesce(idents, F.array().cast("array<int>")), _each(column, one), _each(column, test)


def _matching(pos: Column) -> tuple[Column, Column, Column]:
    sides = right_sides(F.col("pairs"), F.coalesce("distractors", F.array().cast("array<string>")))
    wide = (F.size("pairs") > NARROW) | (F.size(sides) > NARROW)
    left = lambda i: answer_id(pos, i + 1, wide=wide)
    labels = _each(sides, lambda t, i: _label(answer_id(pos, i + 1, True, wide), _plain(t)))
    one = lambda p, i: _el("response_lid", {"ident": F.concat(F.lit("response_"), left(i).cast("string")), "rcardinality": "Single"}, material(p["left"]), _el("render_choice", None, labels))
    share = F.format_string("%.2f", F.lit(100.0) / F.greatest(F.size("pairs"), F.lit(1)))
    right = lambda p: answer_id(pos, F.array_position(sides, p["right"]).cast("int"), True, wide)
    test = lambda p, i: _condition(None, _equal(F.concat(F.lit("response_"), left(i).cast("string")), right(p)), _add(share))
    return F.transform("pairs", lambda p, i: left(i)), _each(F.col("pairs"), one), _each(F.col("pairs"), test)


def _essay() -> tuple[Column, Column, Column]:
    return F.array().cast("array<int>"), _written(None, {"ident": "answer1", "rshuffle": "No"}), _condition("No", _el("other", None))


def item_of() -> Column:
    """The XML of a question row (validation.QUESTION with ident and pos); null for a type without one.

    tf must be split first (split_true_false).  Equal rows give equal texts: attributes and elements have a fixed order.
    """
    pos, kind = F.col("pos"), F.col("type")
    built = {"mc": _choices("mc", pos), "ma": _choices("ma", pos), "short": _short(pos), "num": _numeric(pos), "blanks": _boxes("blanks", pos), "dropdowns": _boxes("dropdowns", pos), "matching": _matching(pos), "essay": _essay()}
    field = lambda name, value: _el("qtimetadatafield", None, _el("fieldlabel", None, name), _el("fieldentry", None, value))
    stem = _html(F.concat(F.lit("<div>"), F.coalesce("stem", F.lit("")), F.lit("</div>")))
    feedback = ~is_blank_html(F.coalesce("feedback", F.lit("")))
    outcomes = '<outcomes><decvar maxvalue="100" minvalue="0" varname="SCORE" vartype="Decimal"></decvar></outcomes>'
    shows = _condition("Yes", _el("other", None), _el("displayfeedback", {"feedbacktype": "Response", "linkrefid": "general_fb"}))
    block = _el("itemfeedback", {"ident": "general_fb"}, _el("flow_mat", None, material(F.col("feedback"))))

    def item(name: str, points: Column, idents: Column, interaction: Column | str, processing: Column | None) -> Column:
        metadata = _el("itemmetadata", None, _el("qtimetadata", None, field("question_type", name), field("points_possible", points), field("original_answer_ids", F.array_join(idents.cast("array<string>"), ","))))
        parts = [metadata, _el("presentation", None, stem, interaction)]
        if processing is not None:
            parts += [_el("resprocessing", None, outcomes, F.when(feedback, shows).otherwise(""), processing), F.when(feedback, block).otherwise("")]
        return _el("item", {"ident": F.col("ident"), "title": F.coalesce("title", F.lit(""))}, *parts)

    out = F.when(kind == "text", item(ITEM_TYPES["text"], F.lit("0"), F.array().cast("array<int>"), "", None))
    for name, (idents, interaction, processing) in built.items():
        out = out.when(kind == name, item(ITEM_TYPES[name], number_text(F.col("points")), idents, interaction, processing))
    return out


def split_true_false(questions: DataFrame) -> DataFrame:
    """tf questions to one mc row a statement (ident and _s<k>), points in equal shares of four places, the last taking the rest."""
    n = F.size("statements")
    rest = [c for c in questions.columns if c not in ("ident", "type", "points", "stem", "choices")]
    rows = questions.where("type = 'tf'").select("*", F.posexplode("statements").alias("_k", "_s"))
    share = F.round(F.col("points") / n, 4)
    word = lambda t, right: F.struct(F.lit(t).alias("id"), F.lit(t).alias("html"), right.alias("correct"))
    choices = F.array(word("Đúng", F.col("_s.value")), word("Sai", ~F.col("_s.value")))
    stem = F.concat(F.coalesce("stem", F.lit("")), F.lit("<p>"), F.col("_s.html"), F.lit("</p>"))
    one = {"ident": F.concat("ident", F.lit("_s"), (F.col("_k") + 1).cast("string")), "type": F.lit("mc"), "points": F.when(F.col("_k") < n - 1, share).otherwise(F.round(F.col("points") - share * (n - 1), 4)), "stem": stem, "choices": choices.cast(questions.schema["choices"].dataType)}
    return questions.where("type <> 'tf'").unionByName(rows.select(*rest, *[v.alias(k) for k, v in one.items()]))


# -- reading back ------------------------------------------------------------------------------------------------------------
_TEXT = "struct<_VALUE:string,_texttype:string>"
_TEST = "array<struct<_VALUE:string,_respident:string>>"
ITEM = f"""_ident string, _title string, itemmetadata struct<qtimetadata:struct<qtimetadatafield:array<struct<fieldlabel:string,fieldentry:string>>>>,
presentation struct<material:struct<mattext:{_TEXT}>,response_lid:array<struct<_ident:string,_rcardinality:string,render_choice:struct<response_label:array<struct<_ident:string,material:struct<mattext:{_TEXT}>>>>>>,response_str:array<struct<_ident:string>>>,
resprocessing struct<respcondition:array<struct<_continue:string,conditionvar:struct<varequal:{_TEST},other:string,vargte:{_TEST},varlte:{_TEST},`and`:struct<varequal:{_TEST},`not`:array<struct<varequal:{_TEST}>>>,`or`:struct<varequal:{_TEST},`and`:struct<vargte:{_TEST},varlte:{_TEST}>>>,setvar:struct<_VALUE:string,_action:string,_varname:string>>>>"""


def parsed(items: DataFrame, xml: str = "xml") -> DataFrame:
    """items with `item`, the XML as a struct (ITEM); null if it isn't well-formed."""
    read = F.from_xml(F.col(xml), f"{ITEM}, _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = items.withColumn("item", read)
    return rows.withColumn("item", F.when(F.col("item._corrupt_record").isNull(), F.col("item").dropFields("_corrupt_record")))


def _field(name: str) -> Column:
    fields = F.filter("item.itemmetadata.qtimetadata.qtimetadatafield", lambda f: f["fieldlabel"] == name)
    return F.get(F.transform(fields, lambda f: F.coalesce(f["fieldentry"], F.lit(""))), F.lit(0))


def _labels() -> Column:
    """All labels of all responses: (response, ident, text)."""
    one = lambda r: F.transform(F.coalesce(r["render_choice"]["response_label"], F.array()), lambda x: F.struct(r["_ident"].alias("response"), x["_ident"].alias("ident"), F.coalesce(x["material"]["mattext"]["_VALUE"], F.lit("")).alias("text")))
    return F.flatten(F.transform("item.presentation.response_lid", one))


def accepted(items: DataFrame) -> DataFrame:
    """parsed items with type, points and accepted: what earns points, told by the condition trees alone.

    An array of (response, value, share): value is the text of the label that must be chosen (for several answers each right one),
    the text or number to write, or low..high; share is the per cent it earns, null where all of them together earn 100.
    """
    conditions = F.filter("item.resprocessing.respcondition", lambda c: c["setvar"].isNotNull())
    labels = F.coalesce(_labels(), F.array().cast("array<struct<response:string,ident:string,text:string>>"))
    text = lambda table, response, ident: F.get(F.transform(F.filter(table, lambda x: (x["response"] == response) & (x["ident"] == ident)), lambda x: x["text"]), F.lit(0))
    rows = items.withColumns({"_labels": labels, "_tests": conditions, "type": _field("question_type"), "points": _field("points_possible").try_cast("double")})
    chosen = F.size("_labels") > 0

    def of(c: Column) -> Column:
        v, adds = c["conditionvar"], c["setvar"]["_action"] == "Add"
        share = F.when(adds, c["setvar"]["_VALUE"].try_cast("double"))
        one = lambda e: F.struct(e["_respident"].alias("response"), F.when(chosen, text(F.col("_labels"), e["_respident"], e["_VALUE"])).otherwise(e["_VALUE"]).alias("value"), share.alias("share"))
        none = F.array().cast("array<struct<response:string,value:string,share:double>>")
        spans = lambda low, high: F.zip_with(F.coalesce(low, F.array().cast(_TEST)), F.coalesce(high, F.array().cast(_TEST)), lambda a, b: F.struct(a["_respident"].alias("response"), F.concat(a["_VALUE"], F.lit(".."), b["_VALUE"]).alias("value"), share.alias("share")))
        equals = [F.transform(e, one) for e in (v["varequal"], v["and"]["varequal"], v["or"]["varequal"])]
        return F.concat(*[F.coalesce(e, none) for e in (*equals, spans(v["vargte"], v["varlte"]), spans(v["or"]["and"]["vargte"], v["or"]["and"]["varlte"]))])

    return rows.withColumn("accepted", F.flatten(F.transform("_tests", of))).drop("_labels", "_tests")


#: Rules on the values of elements: what each must match, how bad it is if not, and how that is told.
VALUE_RULES = [
    ("item/@ident", "^[A-Za-z0-9_][A-Za-z0-9_.-]*$", "error", "ident_form"), ("item/@title", "\\S", "warn", "no_title"),
    ("question_type", "^(" + "|".join(ITEM_TYPES.values()) + ")$", "error", "unknown_type"), ("points_possible", r"^\d+(\.\d{1,4})?$", "error", "points_form"),
    ("original_answer_ids", r"^(\d+(,\d+)*)?$", "error", "ids_form"), ("response_label/@ident", r"^\d+$", "error", "label_form"),
    ("response_label", "\\S", "warn", "empty_label"), ("setvar", r"^\d{1,3}(\.\d{1,2})?$", "error", "share_form"), ("varequal/@respident", "^response", "error", "response_form"),
]


def facts(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, element, value): the values of parsed items that the rules speak of."""
    one = lambda name, v: F.struct(F.lit(name).alias("element"), F.coalesce(v, F.lit("")).alias("value"))
    many = lambda name, array, value: F.coalesce(F.transform(array, lambda x: one(name, value(x))), F.array())
    labels, tests = F.col("_labels"), F.col("item.resprocessing.respcondition")
    equals = F.flatten(F.transform(tests, lambda c: F.coalesce(c["conditionvar"]["varequal"], F.array().cast(_TEST))))
    every = F.concat(
        F.array(one("item/@ident", F.col("item._ident")), one("item/@title", F.col("item._title")), *[one(n, _field(n)) for n in ("question_type", "points_possible", "original_answer_ids")]),
        many("response_label/@ident", labels, lambda x: x["ident"]), many("response_label", labels, lambda x: x["text"]),
        many("setvar", F.filter(tests, lambda c: c["setvar"].isNotNull()), lambda c: c["setvar"]["_VALUE"]), many("varequal/@respident", equals, lambda e: e["_respident"]),
    )
    return items.where("item IS NOT NULL").withColumn("_labels", _labels()).select(*by, F.explode(every).alias("f")).select(*by, "f.*")


def item_issues(items: DataFrame, by: list[str], xml: str = "xml") -> DataFrame:
    """(by, level, code, value) of what is wrong with items: values that break VALUE_RULES, XML that isn't well-formed, answers that
    refer to no label (dangling), label identities given twice in one response, shares that don't come to 100, and nothing that
    earns points."""
    read = cut(parsed(items, xml).select(*by, "item"))  # parsed once, for the rules on values and for those on structure
    rules = items.sparkSession.createDataFrame(VALUE_RULES, "element string, pattern string, level string, code string")
    broken = facts(read, by).join(F.broadcast(rules), "element").where(~F.regexp_like("value", F.col("pattern"))).select(*by, "level", "code", "value").distinct()
    judged = accepted(read)
    labels, got = F.coalesce(_labels(), F.array()), F.col("accepted")
    pairs = F.transform(labels, lambda x: F.struct(x["response"], x["ident"]))
    shares = F.aggregate(got, F.lit(0.0), lambda n, a: n + F.coalesce(a["share"], F.lit(0.0)))
    scored = ~F.col("type").isin(ITEM_TYPES["essay"], ITEM_TYPES["text"])
    some = F.size(got) > 0
    # shares are rounded to two places, so n of them may miss 100 by n halves of a hundredth
    found = {
        "not_well_formed": F.col("item").isNull(), "dangling": F.exists(got, lambda a: a["value"].isNull()), "label_twice": F.size(F.array_distinct(pairs)) < F.size(pairs),
        "shares": some & F.exists(got, lambda a: a["share"].isNotNull()) & (F.abs(shares - 100) > 0.005 * F.size(got) + 1e-9), "earns_nothing": scored & ~F.coalesce(some, F.lit(False)),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in found.items()]))
    structural = judged.select(*by, F.lit("error").alias("level"), F.explode(codes).alias("code"), F.lit(None).cast("string").alias("value"))
    return broken.unionByName(structural)
