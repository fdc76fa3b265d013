"""Checks before an export: pictures, cells that a spreadsheet changed, files that a manifest names; the plan of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.functions.cells import file_name
from exalake.functions.text import is_blank_html, unsafe_html
from exalake.operators.ordered import unique_names

IMAGE_NAME = r"^[a-z0-9][a-z0-9_-]{0,80}\.(png|jpe?g|gif)$"
IMAGE_KINDS = ["png", "jpg", "gif"]
#: Roles of columns in which a date is a trap; option columns are A to H.
DATE_ROLES = ["content", "answer", "points", "solution"]


def html_fragments(stem: Column, stimulus: Column, feedback: Column, *more: Column) -> Column:
    """All HTML of a question in one array without nulls; more: arrays of choices', statements' and left sides' HTML."""
    parts = [F.array(stem, stimulus, feedback), *[F.coalesce(c, F.array().cast("array<string>")) for c in more]]
    return F.array_compact(F.concat(*parts))


def image_issues(fragments: DataFrame, images: DataFrame) -> DataFrame:
    """(bank, id, level, code, name) of pictures that a package can't show, each told once a question.

    fragments: (bank, id, html); images: (bank, name, kind), kind by the first bytes.  A picture from the web is a warning;
    a formula's picture (below /equation_images/, of class equation_image) is left out.
    Tags are exploded before the join, and images are joined by (bank, name) alone.
    """
    tags = fragments.select("bank", "id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))).alias("tag"))
    said = F.regexp_extract("tag", r"(?i)\ssrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 1)
    other = F.concat(F.regexp_extract("tag", r"(?i)\ssrc\s*=\s*'([^']*)'", 1), F.regexp_extract("tag", r"(?i)\ssrc\s*=\s*([^\s>\"']+)", 1))
    named = F.regexp_extract("tag", r"(?i)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1).rlike(r"\bequation_image\b")
    src = tags.select("bank", "id", F.trim(F.when(said != "", said).otherwise(other)).alias("src"), named.alias("formula"))
    src = src.where(~(F.col("formula") & F.col("src").startswith("/equation_images/"))).drop("formula").distinct()
    name = F.regexp_extract("src", r"^images/(.+)$", 1)
    placed = src.withColumn("name", F.when(name != "", name)).join(images.select("bank", "name", "kind").withColumn("known", F.lit(True)), ["bank", "name"], "left")
    code = (
        F.when(F.col("src") == "", "src_missing")
        .when(F.col("src").rlike("(?i)^data:"), "data_uri")
        .when(F.col("src").rlike("(?i)^https?://"), "remote")
        .when(F.col("name").isNull(), "outside")
        .when(F.col("known").isNull(), "absent")
        .when(~F.col("name").rlike(IMAGE_NAME), "bad_name")
        .when(~F.coalesce(F.col("kind").isin(IMAGE_KINDS), F.lit(False)), "bad_bytes")
    )
    told = placed.select("bank", "id", F.when(code == "remote", "warn").otherwise("error").alias("level"), code.alias("code"), F.coalesce("name", "src").alias("name"))
    return told.where("code is not null")


def export_issues(questions: DataFrame, passages: bool = True) -> DataFrame:
    """(bank, pos, level, code): HTML that has to be cleaned again, and a question whose text is in its passage alone while passages stay out."""
    html = F.concat_ws(" ", "stem", "stimulus", "feedback", F.array_join(F.transform("choices", lambda c: c["html"]), " "), F.array_join(F.transform("statements", lambda s: s["html"]), " "))
    lone = ~is_blank_html(F.col("stimulus")) & is_blank_html(F.col("stem")) & (F.col("type") != "text") & ~((F.col("type") == "tf") & (F.coalesce(F.size("statements"), F.lit(0)) > 0))
    one = lambda c, level, code: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(one(unsafe_html(html), "info", "cleaned_again"), one(lone & F.lit(not passages), "warn", "passage_only")))
    return questions.select("bank", "pos", F.explode(found).alias("i")).select("bank", "pos", "i.level", "i.code")


def cell_issues(cells: DataFrame) -> DataFrame:
    """(row, role, level, code) of cells (row, role, date: null, 'day' or 'year', formula_open, error, special, hidden).

    A date without a year where a text is meant is an error (1/2 typed as a fraction), one with a year a warning.
    """
    trap = F.col("role").isin(DATE_ROLES) | F.col("role").rlike("^[A-H]$")
    one = lambda c, level, code: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(
        one(F.col("formula_open"), "warn", "formula_open"), one(F.col("error").isNotNull() & ~F.coalesce("special", F.lit(False)), "warn", "cell_error"), one(F.col("special"), "warn", "special_value"),
        one(trap & (F.col("date") == "day"), "error", "date_without_year"), one(trap & (F.col("date") == "year"), "warn", "date"), one(F.col("hidden"), "warn", "row_hidden"),
    ))
    return cells.select("row", "role", F.explode(found).alias("i")).select("row", "role", "i.level", "i.code")


def option_gaps(filled: Column, columns: Column) -> Column:
    """Option columns left empty before the last filled one."""
    last = F.array_max(F.transform(filled, lambda x: F.array_position(columns, x)))
    return F.array_except(F.slice(columns, F.lit(1), F.coalesce(last, F.lit(0)).cast("int")), filled)


def picture_slots(pictures: DataFrame, columns: DataFrame) -> DataFrame:
    """pictures (sheet, row, col, type) with slot: the option whose column it stands in, 'solution', else 'stem'.  columns: (sheet, col, role)."""
    takes = F.col("type").isin("mc", "ma", "tf", "matching") & F.col("role").rlike("^[A-H]$")
    slot = F.when(takes, F.col("role")).when(F.col("role") == "solution", "solution").otherwise("stem")
    return pictures.join(columns, ["sheet", "col"], "left").withColumn("slot", slot).drop("role")


def manifest_issues(resources: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(package, code, name): resources (package, identifier, href), files (package, path), dependencies (package, identifier, on).

    missing_file, wrong_case (a file of that name in other case), undeclared_file, missing_dependency.
    """
    paths = files.select("package", F.col("path").alias("_path"), F.lower("path").alias("_low"))
    exact = resources.select("package", "href").distinct().join(paths.select("package", F.col("_path").alias("href")), ["package", "href"], "left_anti")
    lows = paths.select("package", "_low").distinct().withColumn("_known", F.lit(True))
    gone = exact.withColumn("_low", F.lower("href")).join(lows, ["package", "_low"], "left").select("package", F.when(F.col("_known"), "wrong_case").otherwise("missing_file").alias("code"), F.col("href").alias("name"))
    loose = paths.join(resources.select("package", F.lower("href").alias("_low")), ["package", "_low"], "left_anti").where("_path <> 'imsmanifest.xml'").select("package", F.lit("undeclared_file").alias("code"), F.col("_path").alias("name"))
    known = resources.select("package", F.col("identifier").alias("on"))
    open_ = dependencies.join(known, ["package", "on"], "left_anti").select("package", F.lit("missing_dependency").alias("code"), F.col("on").alias("name"))
    return gone.unionByName(loose).unionByName(open_)


def package_plan(items: DataFrame, classic: bool) -> DataFrame:
    """(package, banks, items, points): one archive a bank, or one for all.  items: (bank, title, points); empty banks have no row.

    Sums are taken a bank first; names are made unique within the plan, in the order of banks.
    """
    banks = items.groupBy("bank").agg(F.min("title").alias("title"), F.count("*").alias("items"), F.sum("points").alias("points"))
    if not classic:
        named = unique_names(banks.withColumn("_all", F.lit(1)).withColumn("_name", F.concat(file_name(F.col("title")), F.lit(".zip"))), "_name", ["_all"], ["bank"], "package")
        return named.select("package", F.lit(1).cast("long").alias("banks"), "items", F.round("points", 4).alias("points"))
    one = banks.agg(F.count("*").alias("banks"), F.sum("items").alias("items"), F.round(F.sum("points"), 4).alias("points"), F.min("title").alias("title")).where("banks > 0")
    name = F.when(F.col("banks") == 1, F.col("title")).otherwise(F.concat(F.lit("Ngan_hang_cau_hoi_"), F.col("banks").cast("string")))
    return one.select(F.concat(F.when(F.col("banks") == 1, file_name(name)).otherwise(name), F.lit("_classic.zip")).alias("package"), "banks", "items", "points")
