"""Labels accepted one after another: A, then the next B after it, then the next C after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exalake.sources.shared import cut

Names = list[str]
#: Places of a document that one task looks at together.
BLOCK = 1 << 16


def _meet(left: DataFrame, right: DataFrame, key: Names, how: str) -> DataFrame:
    """A join by a key that may be null."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in key])


def next_links(rows: DataFrame, by: Names, line: str, label: str, block: int = BLOCK) -> DataFrame:
    """(by, line, next): the first place below each row where the label that follows its own stands; null if none.

    Those who ask and those who are asked meet by document and label, so a document is dealt by its labels, and long ones by
    blocks of places too.
    """
    have = rows.select(*by, F.col(label).alias("_key"), F.col(line).alias("_at"), F.lit(0).alias("_asks"))
    asks = rows.select(*by, (F.col(label) + 1).alias("_key"), F.col(line).alias("_at"), F.lit(1).alias("_asks"))
    both = have.unionByName(asks).withColumn("_block", F.floor(F.col("_at") / block))
    spot = F.when(F.col("_asks") == 0, F.col("_at"))
    upward = Window.partitionBy(*by, "_key", "_block").orderBy(F.col("_at").desc(), F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by, "_key").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last(spot, ignorenulls=True).over(upward)).where("_asks = 1")
    blocks = both.groupBy(*by, "_key", "_block").agg(F.min(spot).alias("_first"))
    far = blocks.select(*by, "_key", "_block", F.last("_first", ignorenulls=True).over(later).alias("_far"))
    found = _meet(near, far, [*by, "_key", "_block"], "left")
    return found.select(*by, F.col("_at").alias(line), F.coalesce("_near", "_far").alias("next")).distinct()


def reachable(roots: DataFrame, links: DataFrame, by: Names, at: str, longest: int) -> DataFrame:
    """(by, at) of all places that links (by, at, next) lead to from roots (by, at), the roots among them, each once.

    A place has one link at most, and no chain is longer than `longest` places.  Links are doubled, so log2(longest) rounds
    are enough; each is written to the shared folder.
    """
    jump, reached = cut(links.where("next IS NOT NULL")), roots.distinct()
    rounds = max(0, longest - 1).bit_length()
    for turn in range(rounds):
        ahead = _meet(reached, jump, [*by, at], "inner").select(*by, F.col("next").alias(at))
        reached = cut(reached.unionByName(ahead).distinct())
        if turn + 1 < rounds:
            onward = jump.select(*by, F.col("next").alias("_onward"), F.col(at).alias("next"))
            jump = cut(_meet(jump, onward, [*by, "next"], "inner").select(*by, at, F.col("_onward").alias("next")))
    return reached


def accepted(rows: DataFrame, by: Names, line: str, label: str, first: int = 1, out: str = "accepted", block: int = BLOCK) -> DataFrame:
    """rows with `out`: whether the row is in the chain of its document that starts with the first row of label `first` and goes on
    with the first row below that has the next label, and so on.

    label is a whole number (of a letter, say); rows with a null label or place are never in it.  Rows with the same place and
    label are one.  Links to candidate successors are doubled, so a chain of n labels takes log2(n) rounds over the table and
    not n; each round is written to the shared folder.
    """
    known = rows.where(F.col(line).isNotNull() & (F.col(label) >= first)).select(*by, line, label)
    longest = known.agg(F.max(label)).first()[0]
    if longest is None:
        return rows.withColumn(out, F.lit(False))
    roots = known.where(F.col(label) == first).groupBy(*by).agg(F.min(line).alias(line))
    reached = reachable(roots, next_links(known, by, line, label, block), by, line, int(longest) - first + 1)
    # a place may hold several labels: the chain's own is the how many-th of its places
    nth = Window.partitionBy(*by).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    chain = reached.withColumn(label, F.count("*").over(nth) - 1 + first).withColumn(out, F.lit(True))
    return _meet(rows, chain, [*by, line, label], "left").withColumn(out, F.coalesce(out, F.lit(False)))
