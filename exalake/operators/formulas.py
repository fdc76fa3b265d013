r"""Formulas in texts: $...$, $$...$$, \(...\), \[...\]; amounts of money and lone dollar signs are none.

Every place where a formula may begin is looked at on its own: where it would end, and whether that is a formula.  From each
leads one link to the next place that is looked at, behind the formula or just behind the sign.  The places that the first one
leads to are those that a reader from left to right comes to, and the formulas among them don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.functions.cells import decode_entities
from exalake.functions.text import WHITE
from exalake.operators.successors import _meet, reachable
from exalake.sources.shared import cut

Names = list[str]
#: Formatting that may stand within a formula (fixed values).
INNER_TAGS = "b strong i em u span font sub sup small big".split()
#: Tags, and elements that are left alone as a whole; each counts as one sign in the places of formulas.
MARKUP = r"(?is)<(math|script|style|code|pre)\b.*?</\1\s*>|<!--.*?-->|</?[A-Za-z][^>]*>"
SIGN = "\ue000"
TOKENS = rf"\\(?s:.)|\$|{SIGN}"


def _tokens(texts: DataFrame, by: Names) -> DataFrame:
    """(by, n, at, token, before, after): escapes, dollar signs and tags with their place and the characters around them."""
    # what moves of the text between tokens is its width and its ends
    narrow = F.transform(F.split("_flat", TOKENS), lambda g: F.struct(F.char_length(g).alias("wide"), F.left(g, F.lit(1)).alias("head"), F.right(g, F.lit(1)).alias("tail")))
    pieces = F.arrays_zip(narrow.alias("gap"), F.regexp_extract_all("_flat", F.lit(TOKENS), F.lit(0)).alias("token"))
    rows = texts.select(*by, F.posexplode(pieces).alias("n", "t")).select(*by, "n", "t.gap.*", "t.token")
    rows = rows.repartition(*by).dropDuplicates([*by, "n"])  # of repeated rows one counts
    order = Window.partitionBy(*by).orderBy("n")
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.char_length("token"), F.lit(0))
    placed = rows.withColumns({
        "at": F.sum(F.col("wide") + size).over(above) - size,
        "before": F.right(F.concat(F.coalesce(F.lag("token").over(order), F.lit("")), "tail"), F.lit(1)),
        "after": F.left(F.concat(F.coalesce(F.lead("head").over(order), F.lit("")), F.coalesce(F.lead("token").over(order), F.lit(""))), F.lit(1)),
        "tags": F.sum(F.contains("token", F.lit(SIGN)).cast("int")).over(above),
    })
    return placed.where("token IS NOT NULL").drop("wide", "head", "tail")


def _following(asks: DataFrame, places: DataFrame, by: Names, target: str, out: str) -> DataFrame:
    """asks with the first of places (by, at) at or after `target`."""
    both = places.select(*by, F.col("at").alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(asks.select(F.struct("*")).schema[0].dataType).alias("_ask"))
    both = both.unionByName(asks.select(*by, F.col(target).alias("_p"), F.lit(0).alias("_side"), F.struct("*").alias("_ask")))
    # from the end: at one place, places come before those who ask for it
    downward = Window.partitionBy(*by).orderBy(F.col("_p").desc_nulls_last(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(out, F.last(F.when(F.col("_side") == 1, F.col("_p")), ignorenulls=True).over(downward)).where("_side = 0")
    return found.select("_ask.*", F.when(F.col("_p").isNotNull(), F.col(out)).alias(out))


def _balance(tags: Column) -> Column:
    """(closes, opens): closing tags of a formula that were opened before it, and opening ones that it doesn't close."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    start = F.struct(F.array().cast("array<string>").alias("opens"), F.array().cast("array<string>").alias("closes"))

    def step(s: Column, t: Column) -> Column:
        back = F.array_position(F.reverse(F.transform(s["opens"], name)), name(t)).cast("int")
        without = F.filter(s["opens"], lambda _, i: i != F.size(s["opens"]) - back)
        opened = F.struct(F.array_append(s["opens"], t).alias("opens"), s["closes"].alias("closes"))
        closed = F.struct(F.when(back > 0, without).otherwise(s["opens"]).alias("opens"), F.when(back > 0, s["closes"]).otherwise(F.array_append(s["closes"], t)).alias("closes"))
        return F.when(t.rlike("/>$"), s).when(t.startswith("</"), closed).otherwise(opened)

    return F.aggregate(tags, start, step)


def formulas(rows: DataFrame, by: Names, text: str, html: bool = False) -> DataFrame:
    r"""(by, start, stop, tex, display, closes, opens): the formulas of each text (rows of equal `by` must not differ in it).

    $...$ has no white space inside at its ends, and no digit behind it; it ends at the first dollar sign that isn't escaped.
    $$...$$ and \[...\] are displayed.  A formula has something in it.  Places are in characters, stop exclusive; in HTML a
    tag, a comment and an element like script or math count as one character, and a formula may hold none but formatting
    tags: those that it closes without having opened them go before it (closes), those that it leaves open after it
    (opens).  tex is without tags, entities decoded.  A null text has no formulas.
    """
    texts = rows.select(*by, F.col(text).alias("_text")).where(F.col("_text").contains("$") | F.col("_text").contains("\\(") | F.col("_text").contains("\\["))
    texts = texts.withColumn("_flat", F.regexp_replace("_text", MARKUP, SIGN) if html else F.col("_text"))
    found = _tokens(texts, by)
    order, white = Window.partitionBy(*by).orderBy("n"), f"^{WHITE}$"
    up = Window.partitionBy(*by).orderBy(F.col("n").desc())
    dollar = F.col("token") == "$"
    double = dollar & (F.lead("token").over(order) == "$") & (F.lead("at").over(order) == F.col("at") + 1)
    signs = found.withColumn("double", F.coalesce(double, F.lit(False)))
    spot = F.struct("at", "before", "after")
    signs = signs.withColumns({
        "one": F.last(F.when(dollar, spot), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)),
        "two": F.last(F.when(F.col("double"), F.col("at")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -2)),
    })
    opening = signs.where(F.col("token").isin("$", "\\(", "\\["))
    # \( ends at the first \) whatever stands before that
    raw = []
    for name, close in (("round", r"\)"), ("square", r"\]")):
        widths = F.transform(F.split("_flat", "\\\\" + close), lambda p: F.char_length(p) + 2)
        ends = texts.where(F.col("_flat").contains(close)).select(*by, F.posexplode(widths).alias("i", "w")).repartition(*by).dropDuplicates([*by, "i"])
        at = ends.withColumn("at", (F.sum("w").over(Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - 2).cast("long"))
        last = F.max("i").over(Window.partitionBy(*by))
        raw.append((name, at.withColumn("last", last).where("i < last").select(*by, "at")))
    opening = opening.withColumns({"round_from": F.when(F.col("token") == "\\(", F.col("at") + 2), "square_from": F.when(F.col("token") == "\\[", F.col("at") + 2)})
    for name, ends in raw:
        opening = _following(opening, ends, by, f"{name}_from", name)
    close = F.when(F.col("double"), F.col("two")).when(dollar, F.col("one.at")).otherwise(F.coalesce("round", "square"))
    wide = F.col("double") | ~dollar
    opening = opening.withColumns({"close": close, "wide": F.when(wide, 2).otherwise(1)})
    money = (~F.col("double")) & dollar & (F.col("after").rlike(white) | F.col("one.before").rlike(white) | F.col("one.after").rlike("^[0-9]$"))
    inside = _meet(opening, texts.select(*by, "_text", "_flat") if html else texts.select(*by, "_flat"), by, "inner")
    content = F.substring("_flat", F.col("at") + F.col("wide") + 1, F.col("close") - F.col("at") - F.col("wide"))
    tex = F.replace(content, F.lit(SIGN), F.lit("")) if html else content
    good = F.col("close").isNotNull() & (F.col("close") > F.col("at") + F.col("wide")) & ~money
    # $...$ begins with something else than white space, so in plain text there is something in it
    bare = F.regexp_replace(decode_entities(tex), WHITE, "") if html else F.when(wide, F.regexp_replace(tex, WHITE, "")).otherwise("$")
    count = F.char_length(content) - F.char_length(F.replace(content, F.lit(SIGN), F.lit("")))
    tags = F.slice(F.regexp_extract_all("_text", F.lit(MARKUP), F.lit(0)), F.col("tags") + 1, count) if html else F.array().cast("array<string>")
    plain = F.forall(tags, lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1)).isin(INNER_TAGS))
    judged = inside.withColumn("tags_in", F.when(good, tags)).withColumn("valid", good & (bare != "") & F.coalesce(plain, F.lit(True)))
    judged = judged.select(*by, "at", "wide", "valid", F.when(F.col("valid"), F.col("close") + F.col("wide")).alias("stop"), F.when(F.col("valid"), decode_entities(tex) if html else tex).alias("tex"), (F.col("token") == "\\[").alias("square"), "double", "tags_in")
    judged = cut(judged.withColumn("target", F.coalesce("stop", F.col("at") + F.col("wide"))).dropDuplicates([*by, "at"]))
    links = _following(judged.select(*by, "at", "target"), judged.select(*by, "at"), by, "target", "next")
    most = judged.groupBy(*by).count().agg(F.max("count")).first()[0] or 0  # one number
    visited = reachable(judged.groupBy(*by).agg(F.min("at").alias("at")), links.select(*by, "at", "next"), by, "at", most)
    kept = _meet(judged.where("valid"), visited, [*by, "at"], "inner")
    sides = _balance(F.coalesce("tags_in", F.array().cast("array<string>")))
    out = kept.withColumn("sides", sides)
    return out.select(*by, F.col("at").alias("start"), "stop", "tex", (F.col("double") | F.col("square")).alias("display"), F.array_join("sides.closes", "").alias("closes"), F.array_join("sides.opens", "").alias("opens"))
