"""Cells in rectangles: merged cells whose value stands in the upper left corner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = list[str]
#: A rectangle lies in few tiles of about its own size; beyond 2^12 rows and 2^6 columns it is cut into tiles of that size, so
#: no tile holds more than that many cells of a sheet.
MOST_LEVEL = {"r": 12, "c": 6}


def _level(first: str, last: str, axis: str) -> Column:
    """The least power of two that the side fits in, as an exponent."""
    side = F.greatest(F.col(last) - F.col(first) + 1, F.lit(1))
    return F.least(F.ceil(F.log2(side)).cast("int"), F.lit(MOST_LEVEL[axis]))


def _tile(place: Column, level: Column) -> Column:
    return F.call_function("shiftright", place.cast("int"), level)


def anchor_values(cells: DataFrame, rectangles: DataFrame, by: Names, value: str, order: str, wanted: Column, out: str) -> DataFrame:
    """cells with `out`: the value of the upper left cell of the first rectangle (by `order`) that a wanted cell lies in.

    cells have by, r, c and value; rectangles by, r1, c1, r2, c2 (both ends inclusive) and order.  A rectangle doesn't
    count for its own upper left cell.  Without a rectangle, or if nothing stands in the corner, `out` is null; so it is for
    cells that aren't wanted.  Of equal orders the upper, then the left rectangle goes first; of repeated corner cells the
    greatest value counts.  Cells with a null place lie nowhere; a rectangle with a null side holds nothing.

    A rectangle takes its corner's value along once, is dealt to the tiles that it touches, and cells look for it in their tile
    of each size that occurs: an equality join, which a sheet of any size is spread over.
    """
    sized = rectangles.where((F.col("r1") <= F.col("r2")) & (F.col("c1") <= F.col("c2"))).withColumns({"lr": _level("r1", "r2", "r"), "lc": _level("c1", "c2", "c")})
    corners = cells.groupBy(*by, F.col("r").alias("r1"), F.col("c").alias("c1")).agg(F.max(value).alias("_value"))
    tiles = lambda a, b, level: F.explode(F.sequence(_tile(F.col(a), F.col(level)), _tile(F.col(b), F.col(level))))
    dealt = sized.join(corners, [*by, "r1", "c1"], "left").withColumn("tr", tiles("r1", "r2", "lr")).withColumn("tc", tiles("c1", "c2", "lc"))
    dealt = dealt.select(*by, "lr", "lc", "tr", "tc", "r1", "c1", "r2", "c2", F.struct(F.col(order).alias("o"), F.col("r1").alias("r"), F.col("c1").alias("c"), F.col("_value").alias("v")).alias("_by"))
    levels = sized.select("lr", "lc").distinct().collect()  # 13 * 7 at most
    every = F.array(*[F.struct(F.lit(x.lr).alias("lr"), F.lit(x.lc).alias("lc")) for x in levels]).cast("array<struct<lr:int,lc:int>>")
    probes = cells.where(wanted).select(*by, "r", "c").distinct().select(*by, "r", "c", F.explode(every).alias("level")).select(*by, "r", "c", "level.*")
    probes = probes.withColumns({"tr": _tile(F.col("r"), F.col("lr")), "tc": _tile(F.col("c"), F.col("lc"))})
    inside = F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2")) & ~((F.col("r") == F.col("r1")) & (F.col("c") == F.col("c1")))
    found = probes.join(dealt, [*by, "lr", "lc", "tr", "tc"]).where(inside).groupBy(*by, "r", "c").agg(F.min("_by")["v"].alias(out))
    taken = cells.join(found, [*by, "r", "c"], "left")
    return taken.withColumn(out, F.when(wanted, F.col(out)))
