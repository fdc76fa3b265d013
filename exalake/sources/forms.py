"""Exam packages of six forms, read by schema into one: parts, groups of questions, items, and what answers may be chosen from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.functions.cells import decode_entities
from exalake.functions.text import collapse
from exalake.sources.exams import hidden_answers, variant

OPTION = "struct<k:string,t:string>"
#: What each form is read to.  place and of_part tell where a group stands; each is the points of an item that gives none.
COLUMNS = "package form part grp label head type each chosen example example_key options bank people headings items".split()
#: The names that forms give to group types, and the type each means.
PLAYFUL_TYPES = {"imageChoice": "mcq", "match": "bank", "letterMatch": "letters", "choice": "mcq", "reading": "mcq", "yesno": "mcq", "order": "order"}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def escaped(s: Column) -> Column:
    """Plain text as HTML."""
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _same(s: Column) -> Column:
    return s


def letter(place: Column) -> Column:
    """A, B, ... of a place from 0; from the 27th on its number from 1."""
    return F.when(place < 26, F.char(place + 65)).otherwise((place + 1).cast("string"))


def _options(list_: Column, shown=_same) -> Column:
    """Choices as key and text: objects with k and t, or plain values, which are keyed by letters."""
    one = lambda o, i: F.struct(F.coalesce(_get(o, "$.k"), letter(i)).alias("k"), shown(F.coalesce(_get(o, "$.t"), _get(o, "$"))).alias("t"))
    return F.transform(list_, one)


def _keyed(list_: Column, key: str, text: str | None, shown=_same) -> Column:
    """Objects as key and text; plain values are both."""
    one = lambda o: F.struct(F.coalesce(_get(o, f"$.{key}"), _get(o, "$")).alias("k"), shown(F.coalesce(_get(o, f"$.{text}") if text else F.lit(None).cast("string"), _get(o, f"$.{key}"), _get(o, "$"))).alias("t"))
    return F.transform(list_, one)


def _texts(v: Column, path: str) -> Column:
    """A list of texts, or one text, as a list; missing: null."""
    return F.coalesce(_get(v, path, "array<string>"), F.when(_get(v, path).isNotNull(), F.array(_get(v, path))))


def _item(i: Column, q: Column, options: Column, answers: Column, points: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(_get(i, "$.n").alias("n"), q.alias("q"), options.cast(f"array<{OPTION}>").alias("options"), answers.cast("array<string>").alias("answers"), (none if points is None else points).alias("points"))


def _group(rows: DataFrame, **given: Column) -> DataFrame:
    """rows with the columns of a group; what isn't given is null."""
    lists = dict.fromkeys(("options", "people", "headings"), f"array<{OPTION}>") | dict.fromkeys(("chosen", "example", "bank"), "array<string>") | {"each": "double"}
    return rows.select("package", "form", *[given.get(c, F.lit(None)).cast(lists.get(c, "string")).alias(c) if c not in ("part", "grp", "items") else given.get(c, F.col(c)).alias(c) for c in COLUMNS[2:]])


def _exploded(rows: DataFrame, path: str, out: str, at: str) -> DataFrame:
    """A row for each element of an array of the object in column v."""
    return rows.select("*", F.posexplode(_get(F.col("v"), path, "array<variant>")).alias(at, out))


def _full_group(rows: DataFrame, part: str, label: Column, keys: Column | None = None, each: Column | None = None) -> DataFrame:
    """Groups that are written out in full, in column g."""
    g = F.col("g")

    def answer(i: Column) -> Column:
        plain = _texts(i, "$.ans")
        if keys is None:
            return plain
        # a number without quotes is the place of the real answer in the hidden table
        hidden = F.schema_of_variant(F.try_variant_get(i, "$.ans", "variant")).isin("BIGINT")
        return F.when(keys.isNotNull() & hidden, F.array(F.get(keys, _get(i, "$.ans", "int")))).otherwise(plain)

    def item(i: Column) -> Column:
        chosen = F.when(_get(g, "$.type") == "mistake", F.filter(_options(_get(i, "$.seg", "array<variant>")), lambda o: o["t"].isNotNull())).otherwise(_options(_get(i, "$.opts", "array<variant>")))
        return _item(i, _get(i, "$.q"), chosen, answer(i), _get(i, "$.pt", "double"))

    kind = F.when(_get(g, "$.type") == "choice", "mcq").otherwise(_get(g, "$.type"))
    return _group(
        rows, part=F.col(part), label=label, head=_get(g, "$.head"), type=kind, each=each if each is not None else _get(g, "$.perItem", "double"), chosen=_texts(g, "$.ans"),
        example=_texts(g, "$.example.ans"), example_key=_get(g, "$.exampleKey"), options=_options(_get(g, "$.opts", "array<variant>")), bank=_get(g, "$.bank", "array<string>"),
        people=F.coalesce(_keyed(_get(g, "$.people", "array<variant>"), "k", "t"), _keyed(_get(g, "$.keys", "array<variant>"), "k", None)), headings=_keyed(_get(g, "$.list", "array<variant>"), "k", "t"),
        items=F.transform(_get(g, "$.items", "array<variant>"), item),
    )


def template(rows: DataFrame) -> DataFrame:
    """EXAM and PARTS with groups; with _KX and _KM answers are places in a hidden table."""
    keyed = rows.withColumn("keys", hidden_answers(_get(F.col("v"), "$._KX"), _get(F.col("v"), "$._KM")))
    parts = _exploded(keyed, "$.PARTS", "p", "part")
    groups = parts.select("*", F.posexplode(_get(F.col("p"), "$.groups", "array<variant>")).alias("grp", "g"))
    return _full_group(groups, "part", _get(F.col("p"), "$.label"), F.col("keys"))


def passages(rows: DataFrame) -> DataFrame:
    """PASSAGES with groups; every item is worth 1."""
    parts = _exploded(rows, "$.PASSAGES", "p", "part")
    groups = parts.select("*", F.posexplode(_get(F.col("p"), "$.groups", "array<variant>")).alias("grp", "g"))
    return _full_group(groups, "part", F.concat(F.lit("READING PASSAGE "), _get(F.col("p"), "$.no")), each=F.lit(1.0))


def keyed_parts(rows: DataFrame) -> DataFrame:
    """EXAM_INFO and PARTS of one group each; points of an item by the part's type."""
    p, info = F.col("p"), F.col("v")
    kind = _get(p, "$.type")
    each = F.when(kind == "mcq", _get(info, "$.EXAM_INFO.ptI", "double")).when(kind == "short", _get(info, "$.EXAM_INFO.ptIII", "double")).otherwise(1.0)
    item = lambda i: _item(i, _get(i, "$.q"), _options(_get(i, "$.opts", "array<variant>")), _texts(i, "$.ans"))
    return _group(_exploded(rows, "$.PARTS", "p", "part"), grp=F.lit(0), label=_get(p, "$.label"), head=F.lit(""), type=kind, each=each, items=F.transform(_get(p, "$.items", "array<variant>"), item))


def exercises(rows: DataFrame) -> DataFrame:
    """EXERCISES in a row; one with a Roman number opens a part.  Texts are plain; other answers of a bank item are accepted too."""
    x, shown = F.col("x"), escaped
    kind = F.when(_get(x, "$.type").isin("bank", "mistake"), _get(x, "$.type")).otherwise("mcq")
    opened = _exploded(rows, "$.EXERCISES", "x", "at").withColumn("opens", (F.coalesce(_get(x, "$.roman"), F.lit("")) != "") | (F.col("at") == 0))
    # an exam's exercises are one array of one row, so they are few
    in_order = Window.partitionBy("package", "form").orderBy("at")
    parts = opened.withColumn("part", F.sum(F.col("opens").cast("int")).over(in_order) - 1).withColumn("label", F.last(F.when(F.col("opens"), F.coalesce(_get(x, "$.roman"), F.lit(""))), ignorenulls=True).over(in_order))
    parts = parts.withColumn("grp", F.row_number().over(Window.partitionBy("package", "form", "part").orderBy("at")) - 1)

    def item(i: Column) -> Column:
        seg = F.transform(F.filter(_get(i, "$.seg", "array<variant>"), lambda s: _get(s, "$.k").isNotNull()), lambda s: F.struct(_get(s, "$.k").alias("k"), shown(_get(s, "$.t")).alias("t")))
        answers = F.when(kind == "bank", F.concat(_texts(i, "$.ans"), F.coalesce(_texts(i, "$.alt"), F.array().cast("array<string>")))).otherwise(_texts(i, "$.ans"))
        return _item(i, F.coalesce(shown(_get(i, "$.q")), F.lit("")), F.when(kind == "mistake", seg).otherwise(_options(_get(i, "$.opts", "array<variant>"), shown)), answers)

    head = F.concat(_get(x, "$.no"), F.lit(". "), shown(_get(x, "$.instr")))
    return _group(parts, label=F.col("label"), head=head, type=kind, each=F.lit(1.0), example=_texts(x, "$.example.ans"), bank=_get(x, "$.bank", "array<string>"), items=F.transform(_get(x, "$.items", "array<variant>"), item))


def icon_parts(rows: DataFrame) -> DataFrame:
    """EXAM_INFO and PARTS with a number and a title; each is a game, whose answers may be pictures, words, tags or chunks in order."""
    p, shown = F.col("p"), escaped
    game = _get(p, "$.type")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in PLAYFUL_TYPES.items() for x in pair])[game], F.concat(F.lit("UNKNOWN:"), game))
    bank = _get(p, "$.bank", "array<variant>")

    def item(i: Column) -> Column:
        picture = lambda o: F.concat(F.lit('<img src="'), _get(o, "$.img"), F.lit('" alt="'), _get(o, "$.k"), F.lit('">'))
        chosen = F.when(game == "imageChoice", F.transform(_get(i, "$.opts", "array<variant>"), lambda o: F.struct(_get(o, "$.k").alias("k"), picture(o).alias("t")))).when(game != "yesno", _options(_get(i, "$.opts", "array<variant>"), shown))
        chunks = F.map_from_entries(F.transform(_get(i, "$.chunks", "array<variant>"), lambda c: F.struct(_get(c, "$.id"), _get(c, "$.t"))))
        sentence = F.regexp_replace(F.array_join(F.transform(_get(i, "$.target", "array<string>"), lambda t: F.coalesce(chunks[t], F.lit(""))), " "), r"\s+([,.!?])", "$1")
        prompt = F.when(game == "imageChoice", F.concat(F.lit("<b>"), shown(_get(i, "$.prompt")), F.lit("</b>"))).when(game == "order", F.concat(shown(_get(i, "$.prompt")), F.lit(" <b>("), shown(_get(i, "$.cue")), F.lit(")</b>"))).otherwise(shown(_get(i, "$.prompt")))
        return _item(i, prompt, chosen, F.when(game == "order", F.array(sentence)).otherwise(_texts(i, "$.ans")))

    yes_no = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in (("YES", "Yes"), ("NO", "No"))])
    return _group(
        _exploded(rows, "$.PARTS", "p", "part"), grp=F.lit(0), label=F.concat(F.lit("Chặng "), _get(p, "$.id"), F.lit(": "), _get(p, "$.title")), head=F.lit(""), type=kind, each=F.when(game == "order", 2.0).otherwise(1.0),
        options=F.when(game == "yesno", yes_no), bank=F.when(game == "match", F.transform(bank, lambda b: _get(b, "$.v"))), people=F.when(game == "letterMatch", _keyed(bank, "v", "t", shown)),
        example_key=F.when(game == "letterMatch", F.get(F.transform(F.filter(bank, lambda b: F.coalesce(_get(b, "$.example", "boolean"), F.lit(False))), lambda b: _get(b, "$.v")), F.lit(0))),
        items=F.transform(_get(p, "$.items", "array<variant>"), item),
    )


def plain_questions(rows: DataFrame) -> DataFrame:
    """QUESTIONS in a row, each a group of its own: choices by their text, or short answers."""
    q, shown = F.col("q"), escaped
    chosen, right = _get(q, "$.options", "array<string>"), _get(q, "$.answer")
    choice = _get(q, "$.type") == "choice"
    place = F.array_position(chosen, right)
    options = F.transform(chosen, lambda o, i: F.struct(letter(i).alias("k"), shown(o).alias("t")))
    answer = F.when(~choice, right).when(place > 0, letter((place - 1).cast("int"))).otherwise(F.concat(F.lit("UNMATCHED:"), right))
    item = F.array(_item(q, shown(_get(q, "$.prompt")), F.when(choice, options), F.array(answer)))
    return _group(_exploded(rows, "$.QUESTIONS", "q", "grp"), part=F.lit(0), label=F.lit("Phiếu bài tập"), head=F.lit(""), type=F.when(choice, "mcq").otherwise("short"), each=F.lit(1.0), items=item)


READERS = {"template": template, "template-hidden": template, "passages": passages, "keyed-parts": keyed_parts, "exercises": exercises, "icon-parts": icon_parts, "questions": plain_questions}


def groups(packages: DataFrame) -> DataFrame:
    """packages (package, data JSON) to a row a group of questions, whatever their form: the columns COLUMNS.

    options, people and headings are what answers may name, bank words they may be; items hold n, q, options, answers and
    points.  A package without data, with broken JSON or of no known form gives no rows (`unread` tells which).
    """
    parsed = packages.select("package", variant(F.col("data")).alias("form"), F.try_parse_json("data").alias("v")).where("v IS NOT NULL")
    read = [reader(parsed.where(F.col("form").isin(*[f for f, r in READERS.items() if r is reader]))) for reader in dict.fromkeys(READERS.values())]
    return reduce(DataFrame.unionByName, read)


def unread(packages: DataFrame) -> DataFrame:
    """(package, why) of packages that give no groups: `no data`, `broken` or `unknown form`."""
    data = F.col("data")
    why = F.when(data.isNull() | (F.trim(data) == ""), "no data").when(F.try_parse_json("data").isNull(), "broken").when(~variant(data).isin(*READERS), "unknown form")
    return packages.select("package", why.alias("why")).where("why IS NOT NULL")


def items(read: DataFrame) -> DataFrame:
    """A row an item of groups, worked examples (number 0) left out."""
    rows = read.select(*[c for c in COLUMNS if c != "items"], F.posexplode("items").alias("item", "i"))
    return rows.select(*[c for c in rows.columns if c != "i"], F.col("i.n").alias("no"), F.col("i.q").alias("stem"), F.col("i.options").alias("own_options"), F.col("i.answers").alias("answers"), F.coalesce("i.points", "each").alias("points")).where("no IS NULL OR no <> '0'")


def same_word(s: Column) -> Column:
    """What two spellings of a word have in common: tags, entities and kinds of apostrophes aside, blanks collapsed, in lower case."""
    return F.lower(collapse(F.translate(decode_entities(F.regexp_replace(s, "<[^>]*>", " ")), "‘’ʼ", "'''")))
