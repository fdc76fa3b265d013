"""JSON of any shape: every leaf with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = list[str]


def nesting(text: Column) -> Column:
    """How many arrays and objects of a JSON text stand in one another at most; null for null."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]++", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    return F.aggregate(brackets, start, lambda s, c: F.struct((s["now"] + step(c)).alias("now"), F.greatest(s["most"], s["now"] + step(c)).alias("most")), lambda s: s["most"])


def leaves(rows: DataFrame, json: str, depth: int | None = None) -> DataFrame:
    """rows without `json`, with path, kind (string, number, boolean, null, object, array) and text of each leaf of it.

    A path is as in $.a[0].b, names that are no identifiers as in $['a b'].  Empty arrays and objects are leaves with a null text.
    A null or broken JSON text has none.  Whole rows repeat as they stand.  depth is the deepest nesting, or it is found by a
    pass over the texts; levels are opened one by one without a shuffle, and rows that are open already pass through.
    """
    if depth is None:
        depth = rows.agg(F.max(nesting(F.col(json)))).first()[0] or 0  # one number
    keep = [c for c in rows.columns if c != json]
    walked = rows.select(F.struct(*keep).alias("_row"), F.try_parse_json(json).alias("_v"), F.lit("$").alias("path")).where("_v IS NOT NULL")
    for _ in range(depth):
        opened = walked.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
        quoted = F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']"))
        name = F.when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), F.col("key"))).otherwise(quoted)
        step = F.when(F.col("pos").isNull(), "").when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(name)
        walked = opened.select("_row", F.when(F.col("pos").isNull(), F.col("_v")).otherwise(F.col("value")).alias("_v"), F.concat("path", step).alias("path"))
    schema = F.schema_of_variant("_v")
    kind = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")
    text = F.when(~kind.isin("object", "array"), F.try_variant_get("_v", "$", "string"))
    return walked.select("_row.*", "path", kind.alias("kind"), text.alias("text"))
