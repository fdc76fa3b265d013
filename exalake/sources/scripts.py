"""Scripts of pages: bodies, the region that holds data, blocks in braces, functions.  Nothing is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A script that declares one of these holds an exam's data (fixed values).
DATA_NAMES = "EXAM|EXAM_INFO|PARTS|PASSAGES|EXERCISES|QUESTIONS"
DECLARES_DATA = rf"\b(?:var|let|const)\s+(?:{DATA_NAMES})\s*="
#: Marks around the region to edit, and the line that follows it where there are none (fixed values).
OPENING_MARK, CLOSING_MARK, LINE_AFTER = "PHẦN 1/2", r"HẾT PHẦN SỬA\.\s*PHẦN 2/2", r"(?m)^[ \t]*var\s+SCORM\s*="
#: What is cut out of a script, first come first served: comments, strings, heads of functions, braces.
TOKENS = r"""/\*(?s:.*?)\*/|//[^\n]*+|"[^"]*+"|'[^']*+'|`[^`]*+`|\bfunction\s+[A-Za-z_$][\w$]*+\s*\(|[{}]"""


def inline_scripts(pages: DataFrame, by: list[str], html: str) -> DataFrame:
    """(by, script, body): the scripts written into each page, in order from 0; those from elsewhere (src) count but have no row."""
    pattern = F.lit(r"(?is)<script(\s[^>]*)?>(.*?)</script>")
    found = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("head"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("body"))
    rows = pages.select(*by, F.posexplode(found).alias("script", "s"))
    return rows.where(~F.coalesce(F.col("s.head"), F.lit("")).rlike(r"\bsrc\s*=")).select(*by, "script", F.col("s.body").alias("body"))


def data_region(body: Column) -> Column:
    """(text, how): the part of a script that holds data: between the marks' comments, or else all before `var SCORM =`.

    Null if neither is there.
    """
    opening, closing, after = F.instr(body, OPENING_MARK), F.regexp_instr(body, F.lit(CLOSING_MARK)), F.regexp_instr(body, F.lit(LINE_AFTER))
    start = F.call_function("locate", F.lit("*/"), body, opening) + 2
    above = F.substring(body, F.lit(1), closing - 1)
    stop = F.char_length(above) - F.char_length(F.substring_index(above, "/*", -1)) - 2  # characters before the last /*
    marked = F.struct(F.substring(body, start, F.greatest(stop - start + 1, F.lit(0))).alias("text"), F.lit("marks").alias("how"))
    before = F.struct(F.substring(body, F.lit(1), after - 1).alias("text"), F.lit("before").alias("how"))
    return F.when((opening > 0) & (closing > opening), marked).when(after > 0, before)


def tokens(scripts: DataFrame, by: list[str], body: str) -> DataFrame:
    """(by, at, token): braces and heads of functions with their place in the body (from 0); none within strings and comments.

    An escaped character is taken for a plain one of the same length first, so it can't end a string.
    """
    masked = F.regexp_replace(body, r"\\[^\n]", "__")
    cut = F.arrays_zip(F.split(masked, TOKENS).alias("gap"), F.regexp_extract_all(masked, F.lit(TOKENS), F.lit(0)).alias("token"))
    rows = scripts.select(*by, F.posexplode(cut).alias("n", "t")).where("t.token IS NOT NULL")
    above = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("at", F.sum(F.char_length("t.gap") + F.char_length("t.token")).over(above) - F.char_length("t.token"))
    return placed.select(*by, F.col("at").cast("int").alias("at"), F.col("t.token").alias("token")).where(F.col("token").isin("{", "}") | F.col("token").startswith("function"))


def blocks(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, open, close, depth): each brace with the one that closes it (null if none does); depth from 1.

    Braces of one depth alternate, so the next of an opening one's depth closes it.  A closing brace too many closes nothing.
    """
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1)
    above = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    braces = found.where(F.col("token").isin("{", "}")).withColumn("sum", F.sum(step).over(above))
    # a closing brace too many must not let later ones sink below: depth counts from the lowest sum so far
    braces = braces.withColumn("low", F.least(F.min("sum").over(above), F.lit(0)))
    level = F.when(F.col("token") == "{", F.col("sum") - F.col("low")).otherwise(F.col("sum") - F.col("low") + 1)
    stray = (F.col("token") == "}") & (F.col("sum") == F.col("low")) & (F.coalesce(F.lag("low").over(Window.partitionBy(*by).orderBy("at")), F.lit(0)) > F.col("low"))
    levelled = braces.withColumn("depth", level).withColumn("stray", stray).where(~F.col("stray"))
    # after a stray brace the levels start anew: braces on both sides of it never pair
    same = Window.partitionBy(*by, "low", "depth").orderBy("at")
    paired = levelled.withColumn("close", F.when(F.lead("token").over(same) == "}", F.lead("at").over(same)))
    return paired.where("token = '{'").select(*by, F.col("at").alias("open"), "close", F.col("depth").cast("int").alias("depth"))


def functions(scripts: DataFrame, by: list[str], body: str) -> DataFrame:
    """(by, name, at, source): each function declared by name, from its head to the brace that closes its body (null if none)."""
    found = tokens(scripts, by, body)
    up = Window.partitionBy(*by).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    heads = found.withColumn("open", F.last(F.when(F.col("token") == "{", F.col("at")), ignorenulls=True).over(up)).where("token LIKE 'function%'")
    named = heads.select(*by, F.regexp_extract("token", r"function\s+([A-Za-z_$][\w$]*)", 1).alias("name"), "at", "open")
    closed = named.join(blocks(found, by).drop("depth"), [*by, "open"], "left")
    return closed.join(scripts.select(*by, F.col(body).alias("_body")), by).select(*by, "name", "at", F.substring("_body", F.col("at") + 1, F.col("close") - F.col("at") + 1).alias("source"))
