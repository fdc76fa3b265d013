"""Context of ordered lines: what the marks above a line say, in scopes within scopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]
#: Lines of a document that one task looks at together.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Scope:
    """A scope that opens where `opens` holds, with `value`.  One that stands before it in the list ends it, or a row of `closes`.

    keeps: it goes on through those before it (a default, say).
    """

    name: str
    opens: Column
    value: Column
    closes: Column | None = None
    keeps: bool = False


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def running_context(rows: DataFrame, by: Names, line: str, scopes: list[Scope], counted: Column, block: int = BLOCK) -> DataFrame:
    """rows with, for each scope, its value (null outside), `name`_no: the how many-th of its kind it is since one of
    those before it opened (from 1; null outside), and `name`_nth: how many `counted` rows stand in it at or above the row.

    line is the place of a row in its document (by), a whole number; rows of one place come in no fixed order, so places should
    differ.  A mark's row is within its scope; a row that both closes and opens a scope opens it.  Null conditions don't
    hold; a document is a value of `by`, null too.

    Every count and mark is folded twice in the same order: within blocks of lines, and over the blocks of a document, of which
    only the sums and last marks meet.  So a long document is spread over tasks.
    """
    limits = [s for s in scopes if not s.keeps]
    around = {s.name: [] if s.keeps else limits[: limits.index(s)] for s in scopes}
    key = [*by, "_block"]
    flags = {f"_n_{s.name}": _true(s.opens).cast("long") for s in scopes} | {"_n": _true(counted).cast("long")}
    here = rows.withColumn("_block", F.floor(F.col(line) / block)).withColumns(flags)
    within = Window.partitionBy(*key).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(state: DataFrame, columns: list[str], fold) -> DataFrame:
        """What the blocks above each block come to: a row a block."""
        return state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[fold(c).over(before).alias(f"{c}_0") for c in columns])

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
        return left.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(key))])

    sums = carried(here.groupBy(*key).agg(*[F.sum(c).alias(c) for c in flags]), list(flags), F.sum)
    summed = meet(here.withColumns({f"{c}_s": F.sum(c).over(within) for c in flags}), sums).withColumns({c: F.col(f"{c}_s") + F.coalesce(F.col(f"{c}_0"), F.lit(0)) for c in flags})
    # a mark carries all counts as they stand above it
    counts = F.struct(*[(F.col(c) - of).alias(c) for c, of in flags.items()])
    marks = {}
    for s in scopes:
        resets = [_true(o.opens) for o in around[s.name]]
        ends = resets + ([_true(s.closes)] if s.closes is not None else [])
        opened = F.struct(F.lit(True).alias("open"), s.value.alias("v"), counts.alias("n"))
        ended = F.struct(F.lit(False).alias("open"), F.lit(None).cast(rows.select(s.value).schema[0].dataType).alias("v"), counts.alias("n"))
        mark = F.when(_true(s.opens), opened)
        for end in ends:
            mark = mark.when(end, ended)
        marks[f"_m_{s.name}"] = mark
        if resets:
            marks[f"_r_{s.name}"] = F.when(F.greatest(*resets, F.lit(False)), counts)
    marked = summed.withColumns(marks)
    last = carried(marked.groupBy(*key).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(line))).alias(m) for m in marks]), list(marks), lambda c: F.last(c, ignorenulls=True))
    known = meet(marked.withColumns({m: F.last(m, ignorenulls=True).over(within) for m in marks}), last).withColumns({m: F.coalesce(m, f"{m}_0") for m in marks})
    out = []
    for s in scopes:
        mark, own = F.col(f"_m_{s.name}"), f"_n_{s.name}"
        # its own mark is one more than stood above it
        above = F.coalesce(F.col(f"_r_{s.name}")[own], F.lit(0)) if around[s.name] else F.lit(0)
        out += [F.when(mark["open"], mark["v"]).alias(s.name), F.when(mark["open"], mark["n"][own] + 1 - above).alias(f"{s.name}_no"), F.when(mark["open"], F.col("_n") - mark["n"]["_n"]).alias(f"{s.name}_nth")]
    return known.select(*rows.columns, *out)
