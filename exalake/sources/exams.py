"""Exam packages whose data are JSON literals: variant, hidden answer table, questions.  Package code is never run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Question type of each group type (fixed values); others are reported, not guessed.
GROUP_TYPES = {"mcq": "mc", "mistake": "mc", "multi": "ma", "tf": "tf", "short": "short", "order": "short", "gap": "blanks", "flow": "blanks", "bank": "dropdowns", "letters": "matching", "select": "matching"}
PARTS = "array<struct<label:string,points:string,groups:array<struct<type:string,head:string,perItem:double,bank:array<string>,items:array<struct<n:int,q:string,opts:array<string>,ans:string,pt:double>>>>>>"


def variant(data: Column) -> Column:
    """Which of the known package forms a JSON object is, by its names."""
    keys = F.json_object_keys(data)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    part = lambda name: F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(data, "$.PARTS[0]")), name), F.lit(False))
    return (
        F.when(has("EXAM") & part("groups"), F.when(has("_KX"), "template-hidden").otherwise("template"))
        .when(has("PASSAGES"), "passages")
        .when(has("EXERCISES"), "exercises")
        .when(has("QUESTIONS"), "questions")
        .when(has("EXAM_INFO") & part("key") & part("items"), "keyed-parts")
        .when(has("EXAM_INFO") & (part("icon") | part("id")), "icon-parts")
        .otherwise("unknown")
    )


def hidden_answers(table: Column, key: Column) -> Column:
    """The answer table: base64, each byte xor the repeated key and (31 * place) mod 256, a JSON array; its entries as JSON texts."""
    clean = F.regexp_replace(F.translate(table, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    octets = F.regexp_extract_all(F.hex(F.unbase64(F.concat(clean, F.repeat(F.lit("="), (4 - F.length(clean) % 4) % 4)))), F.lit(".."), F.lit(0))
    letters = F.split(key, "")
    open_ = F.transform(octets, lambda x, i: F.lpad(F.hex(F.conv(x, 16, 10).cast("int").bitwiseXOR(F.ascii(F.get(letters, (i % F.size(letters)).cast("int"))).bitwiseAND(F.lit(255))).bitwiseXOR((i * 31).cast("int").bitwiseAND(F.lit(255)))), 2, "0"))
    return F.from_json(F.decode(F.unhex(F.array_join(open_, "")), "UTF-8"), "array<string>")


def questions(packages: DataFrame) -> DataFrame:
    """packages (package, data JSON) of the template forms to a row a question, in order, with its answer looked up.

    Columns: package, part, grp, item (places from 0), label, type (null if the group type is unknown), no, stem, options,
    answer, points.  A whole-number answer of a hidden table is the place of the real one; out of the table it is null.
    """
    data = F.col("data")
    keys = hidden_answers(F.get_json_object(data, "$._KX"), F.get_json_object(data, "$._KM"))
    rows = packages.where(variant(data).startswith("template")).select("package", F.from_json(F.get_json_object(data, "$.PARTS"), PARTS).alias("parts"), keys.alias("keys"))
    rows = rows.select("package", "keys", F.posexplode("parts").alias("part", "p"))
    rows = rows.select("package", "keys", "part", F.col("p.label").alias("label"), F.posexplode("p.groups").alias("grp", "g"))
    rows = rows.select("package", "keys", "part", "label", "grp", F.col("g.type").alias("group_type"), F.col("g.perItem").alias("each"), F.col("g.bank").alias("bank"), F.posexplode("g.items").alias("item", "q"))
    place = F.col("q.ans").try_cast("int")
    answer = F.when(F.col("keys").isNotNull() & F.col("q.ans").rlike(r"^\d+$"), F.get("keys", place)).otherwise(F.col("q.ans"))
    kind = F.create_map(*[F.lit(x) for pair in GROUP_TYPES.items() for x in pair])[F.col("group_type")]
    used = F.col("q.n").isNull() | (F.col("q.n") != 0)  # number 0 is the worked example
    return rows.where(used).select("package", "part", "grp", "item", "label", kind.alias("type"), F.col("q.n").cast("string").alias("no"), F.col("q.q").alias("stem"), F.coalesce("q.opts", "bank").alias("options"), answer.alias("answer"), F.coalesce("q.pt", "each").alias("points"))


def answer_table_use(packages: DataFrame) -> DataFrame:
    """(package, entries, used, outside): of each hidden table how many entries there are and are used, and wrong places."""
    data = F.col("data")
    keys = hidden_answers(F.get_json_object(data, "$._KX"), F.get_json_object(data, "$._KM"))
    places = F.transform(F.regexp_extract_all(F.get_json_object(data, "$.PARTS"), F.lit(r'"ans"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.cast("int"))
    rows = packages.where(F.get_json_object(data, "$._KX").isNotNull()).select("package", F.size(keys).alias("entries"), F.array_distinct(places).alias("places"))
    return rows.select("package", "entries", F.size(F.filter("places", lambda x: x < F.col("entries"))).alias("used"), F.size(F.filter("places", lambda x: x >= F.col("entries"))).alias("outside"))
