"""Operators on ordered rows: fills, nearest rows above, runs, occurrence ranks, segments, splits, unique names.

Each takes the columns that part the rows; a part is sorted within one task, so parts should be documents, sheets or users,
not the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Names = list[str]


def forward_fill(rows: DataFrame, column: str, by: Names, order: Names, out: str) -> DataFrame:
    """The last value that is not null at or above each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(w))


def fill_until(rows: DataFrame, column: str, stop: Column, by: Names, order: Names, out: str) -> DataFrame:
    """forward_fill that a stop row ends: after it the value is null until the next one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(stop, F.struct(F.lit(True).alias("ended"), F.lit(None).cast(rows.schema[column].dataType).alias("v"))).when(F.col(column).isNotNull(), F.struct(F.lit(False).alias("ended"), F.col(column).alias("v")))
    return rows.withColumn("_mark", mark).withColumn(out, F.last("_mark", ignorenulls=True).over(w)["v"]).drop("_mark")


def nearest_above(marks: DataFrame, rows: DataFrame, by: Names, at: str, value: str, out: str) -> DataFrame:
    """Each mark with the value of the last row of the same part at or above it; if none, of the first row (as-of join).

    One sort of both sides together; at and value are columns of rows, at also of marks.  Of rows at one place the greatest
    value counts as the last, the least as the first.  The first row is a whole part's least one: a frame that only grows or
    never changes is read once, one that begins at each row is read again from every row on.
    """
    both = rows.select(*by, at, F.struct(F.col(value).alias("v")).alias("_row"), F.lit(0).alias("_side"), F.lit(None).cast(marks.select(F.struct("*")).schema[0].dataType).alias("_mark")).unionByName(marks.select(*by, at, F.lit(None).cast(rows.select(F.struct(F.col(value).alias("v"))).schema[0].dataType).alias("_row"), F.lit(1).alias("_side"), F.struct("*").alias("_mark")))
    order = Window.partitionBy(*by).orderBy(at, "_side", "_row")
    up, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = both.withColumn("_found", F.coalesce(F.last("_row", ignorenulls=True).over(up), F.first("_row", ignorenulls=True).over(whole)))
    return found.where("_side = 1").select("_mark.*", F.col("_found.v").alias(out))


def runs(rows: DataFrame, column: str, by: Names, order: Names) -> DataFrame:
    """Adjacent rows of equal value as one: by, column, run (from 1), n, first and last of the first order column."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.col(column).eqNullSafe(F.lag(column).over(w))).cast("int"), F.lit(1))
    change = F.when(F.row_number().over(w) == 1, 1).otherwise(change)
    marked = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", column).agg(F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


def occurrence(rows: DataFrame, key: Names, order: Names, out: str = "nth") -> DataFrame:
    """How many-th row with its key each row is, from 1."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def segments(rows: DataFrame, no: str, by: Names, order: Names, out: str = "segment") -> DataFrame:
    """A new segment begins when a number comes again within the segment (state that no window has).

    A part is sorted by Spark and streamed; only the numbers of the open segment are kept.  A row without a number stays in
    the open segment.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, seg = None, set(), 0
        for batch in batches:
            said = []
            for *key, x in zip(*[batch.column(c).to_pylist() for c in (*by, no)], strict=True):
                if key != now:
                    now, seen, seg = key, set(), 1
                elif x in seen:
                    seen, seg = set(), seg + 1
                if x is not None:
                    seen.add(x)
                said.append(seg)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.int32())], names=[*batch.schema.names, out])

    rest = [c for c in rows.columns if c not in (*by, *order, no)]
    return rows.repartition(*by).sortWithinPartitions(*by, *order, no, *rest).mapInArrow(fold, T.StructType([*rows.schema, T.StructField(out, T.IntegerType())]))


def equal_split(rows: DataFrame, total: str, by: Names, order: Names, out: str, places: int = 4) -> DataFrame:
    """A total in equal shares, rounded; the last row of a part takes what is left."""
    w = Window.partitionBy(*by)
    n, nth = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    share = F.round(F.col(total) / n, places)
    return rows.withColumn(out, F.when(nth < n, share).otherwise(F.round(F.col(total) - share * (n - 1), places)))


def unique_names(rows: DataFrame, name: str, by: Names, order: Names, out: str) -> DataFrame:
    """Names that differ, case aside: the second of a name gets _2, the third _3; a number that makes a given name is passed over.

    Each name is numbered on its own; only given names that end in _ and a number (of 2 or more, without zeros before it) meet
    the name that they may be taken for.
    """
    ended = r"^(.*)_([2-9]|[1-9][0-9]{1,8})$"
    given = rows.select(*by, F.lower(name).alias("_n")).where(F.col("_n").rlike(ended)).select(*by, F.regexp_extract("_n", ended, 1).alias("_low"), F.regexp_extract("_n", ended, 2).cast("int").alias("_k"))
    taken = given.groupBy(*by, "_low").agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    nth = F.row_number().over(Window.partitionBy(*by, "_low").orderBy(*order))
    numbered = rows.withColumn("_low", F.lower(name)).withColumn("_nth", nth)
    named = [F.col(f"_g_{c}") for c in (*by, "_low")]
    met = numbered.join(taken.withColumnsRenamed({c: f"_g_{c}" for c in (*by, "_low")}), [F.col(c).eqNullSafe(g) for c, g in zip((*by, "_low"), named, strict=True)], "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_nth"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    return met.withColumn(out, F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), free.cast("string")))).select(*rows.columns, out)


def first_match(rows: DataFrame, by: Names, order: list) -> DataFrame:
    """The first row of each part."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
