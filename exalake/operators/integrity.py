"""References checked from both sides, overlaps of spans, lookups with fallbacks, comparison of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Names = list[str]


def orphans(left: DataFrame, right: DataFrame, key: Names, left_only: str = "undeclared", right_only: str = "unused") -> DataFrame:
    """Keys on one side only, with which: two anti joins on the same partitioning."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("issue", F.lit(left_only)).unionByName(b.join(a, key, "left_anti").withColumn("issue", F.lit(right_only)))


def overlaps(left: DataFrame, right: DataFrame, by: Names, width: int, left_span: tuple[str, str] = ("a_start", "a_end"), right_span: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs whose half-open integer spans overlap: both sides dealt to buckets of `width`, met by equality.

    A pair is given once, in the bucket where the later of both begins.
    """
    (ls, le), (rs, re_) = left_span, right_span
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    a, b = left.withColumn("_bucket", bucket(ls, le)), right.withColumn("_bucket", bucket(rs, re_))
    meet = (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.floor(F.greatest(ls, rs) / width) == F.col("_bucket"))
    return a.join(b, [*by, "_bucket"]).where(meet).drop("_bucket")


def lookup_first(rows: DataFrame, table: DataFrame, keys: list[tuple[str, str]], row_id: str, value: str, out: str) -> DataFrame:
    """The value by the first pair of columns (of rows, of table) that matches; of several matches the least value.

    One join on (priority, key) instead of one for each fallback.
    """
    asked = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(a).cast("string").alias("k")) for i, (a, _) in enumerate(keys)])).alias("x")).select(row_id, "x.*")
    known = table.select(value, F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(b).cast("string").alias("k")) for i, (_, b) in enumerate(keys)])).alias("x")).select(value, "x.*")
    best = asked.join(known.groupBy("p", "k").agg(F.min(value).alias(value)), ["p", "k"]).groupBy(row_id).agg(F.min_by(value, "p").alias(out), F.min("p").alias(f"{out}_by"))
    return rows.join(best, row_id, "left")


def versions(old: DataFrame, new: DataFrame, key: Names, compare: Names) -> DataFrame:
    """Each key of either side: added, removed, changed or same."""
    a = old.select(*key, F.struct(*compare).alias("_old"))
    b = new.select(*key, F.struct(*compare).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))
