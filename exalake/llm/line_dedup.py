"""Line dedup: an exact set-similarity join of lines, in DataFrame functions alone.

A line is the set of its tokens.  All tokens of the corpus are put in one order, rare ones first; lines whose Jaccard
similarity reaches the threshold then share one of their first few tokens (the prefix).  Pairs that share one are cut down
by length, by position and by a parity bitmap (each bit that differs is a token that differs), then verified on the whole
sets.  A line goes if a line before it, by document id and place, is similar to it.

Lines of one token set are one row from the start, numbered in the order of the lines.  Each first meets the earliest line
that has two of its three rarest tokens, which settles most members of a cluster.  All lines are then dealt to groups by a
token of the prefix and the size class of the shorter line of a pair.  No pairs are made: a line of a group is kept or not by
whether there is a line before that passes the filters, and then, on the whole sets, whether one of those is similar.  A group
of many lines is dealt once more by a later token of the prefix (one longer for this), which similar lines share as well.
Tokens take turns, so that a part of the prefixes is on disk at a time.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.llm.text_arrays import drop, materialise, may_hold, one_bit

#: Similarity as a fraction, so that bounds are exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Characters (outer blanks off) of a line that takes part: every line with a token; blank lines alone stay.
LEAST_CHARS = 1
#: Places of the rarity table, whatever the size of the corpus.  A place counts all its tokens together, so a token can pass
#: for more frequent than it is, never for rarer.  They order tokens only: what is found does not depend on them.
RARITY_PLACES = 1 << 17
#: A group of at least so many lines is dealt once more by a second token; lines of others all meet at once.
MANY_PREFIXES = 1024
#: Turns that the tokens take.
TURNS = 2
#: Sets of fewer tokens are similar to equal sets only, which are one row.
LEAST_TOKENS = -(-NUMERATOR // (DENOMINATOR - NUMERATOR))
#: From this size class on (sets of 2 ** class tokens at least) parity has two words.
WIDE_CLASS = 6
_HASH_BITS = 56


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows with equal id and text hash are one document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def lines(rows: DataFrame) -> DataFrame:
    """A row for each line with a token: id, h, no (from 0), line."""
    out = rows.select("id", "h", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return out.where(F.char_length(F.trim("line")) >= LEAST_CHARS)


def hashed(line: Column) -> Column:
    """The distinct tokens of a line as hashes."""
    keys = F.array_distinct(F.transform(F.split(F.lower(line), " "), lambda t: F.xxhash64(t)))
    return F.array_remove(keys, F.xxhash64(F.lit("")))


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(RARITY_PLACES - 1).cast("long")).cast("int")


def token_sets(rows: DataFrame) -> DataFrame:
    """A row for each line: id, h, no, keys (its distinct tokens as hashes).  Texts are split and hashed here alone."""
    return lines(rows).select("id", "h", "no", hashed(F.col("line")).alias("keys"))


def rarity(rows: DataFrame) -> Column:
    """How often the tokens of each place occur, in half powers of two: one number a place, a constant of fixed size.

    Every token of every text is counted.
    """
    tokens = rows.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    counts = tokens.select(_place(F.xxhash64("t")).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    table = bytearray(RARITY_PLACES)
    places = materialise(counts.select("at", _class(F.col("n")).alias("n")), "rarity")
    for at, n in places.collect():  # a row a place at most
        table[at] = n
    drop(places)
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # folded to a constant


def _class(n: Column) -> Column:
    return F.floor(2 * F.log2(n)).cast("int")


def line_sets(every: DataFrame, rare: Column) -> DataFrame:
    """token_sets as id, h, no, s1 and s2 (the digest of the set), n (tokens), prefix (the first tokens and one more), bits (parity of hashed tokens) and bits2 (that of half of them, for large sets)."""
    low = F.lit((1 << _HASH_BITS) - 1).cast("long")
    ranked = F.sort_array(F.transform("keys", lambda k: F.shiftleft(F.coalesce(F.get(rare, _place(k)).cast("long"), F.lit(0).cast("long")), _HASH_BITS).bitwiseOR(k.bitwiseAND(low))))
    none = F.lit(0).cast("long")
    spot = lambda k: one_bit(F.shiftrightunsigned(k, 57))
    bits = F.aggregate("keys", none, lambda acc, k: acc.bitwiseXOR(spot(k)))
    half = F.aggregate("keys", none, lambda acc, k: acc.bitwiseXOR(spot(k).bitwiseAND(F.shiftright(k, 63))))  # of negative keys
    n = F.size("keys")
    return every.withColumn("ranked", ranked).select("id", "h", "no", F.xxhash64("ranked").alias("s1"), F.xxhash64(F.lit(1), "ranked").alias("s2"), n.alias("n"), F.slice("ranked", F.lit(1), _first(n) + 1).alias("prefix"), bits.alias("bits"), F.when(n >= 1 << WIDE_CLASS, half).otherwise(none).alias("bits2"))


def _first(n: Column) -> Column:
    """Tokens of the prefix of a set of n."""
    return (n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1).cast("int")


def may_match(a: str, b: str) -> Column:
    """Length, position and parity filters: false only for pairs that can't reach the similarity."""
    an, bn, whole = F.col(f"{a}.n"), F.col(f"{b}.n"), NUMERATOR + DENOMINATOR
    differ = [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("bits", "bits2")]
    parity = (differ[0] + differ[1]) * whole <= (an + bn) * (DENOMINATOR - NUMERATOR)
    length = (an * NUMERATOR <= bn * DENOMINATOR) & (bn * NUMERATOR <= an * DENOMINATOR)
    place = F.least(an - F.col(f"{a}.pos"), bn - F.col(f"{b}.pos")) * whole >= (an + bn) * NUMERATOR
    return length & place & parity


def grown(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, however small it is today."""
    return side.hint("merge")


def leaders(sets: DataFrame) -> DataFrame:
    """(a, b): lines and the earliest one that has two of their three rarest tokens."""
    rare = [F.get("prefix", F.lit(i)) for i in range(3)]
    two = F.array_compact(F.array(*[F.when(y.isNotNull(), F.xxhash64(x, y)) for x, y in combinations(rare, 2)]))
    keyed = sets.where(F.col("n") >= LEAST_TOKENS).select("u", F.explode(two).alias("k"))
    first = materialise(keyed.groupBy("k").agg(F.min("u").alias("b"), F.count("*").alias("c")).where("c > 1").select("k", "b"), "leaders")
    met = keyed.where(may_hold(first, "k")(F.col("k"))).join(grown(first), "k").where("b < u").select(F.col("u").alias("a"), "b")
    met = materialise(met.distinct(), "led")
    drop(first)
    return met


def groups(sets: DataFrame) -> DataFrame:
    """(key, u, n, bits, bits2, pos, token, later): the groups of each line; later, the tokens of the prefix behind.

    A pair meets in the size class of its shorter line; a longer line is in that class as well if its own is the next.
    """
    n, log = F.col("n"), lambda x: F.length(F.bin(x)) - 1
    least = F.ceil(n * NUMERATOR / DENOMINATOR).cast("int")
    # tokens that a set of n has in common with a similar one of m at least
    common = lambda m: F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR)).cast("int")
    own = F.struct(log(n).alias("class"), (n - common(F.greatest(least, F.call_function("shiftleft", F.lit(1), log(n)))) + 1).alias("first"))
    below = F.struct(log(least).alias("class"), (n - common(least) + 1).alias("first"))
    both = F.when(log(n) == log(least), F.array(own)).otherwise(F.array(own, below))
    classed = sets.where(n >= LEAST_TOKENS).select("u", "n", "bits", "bits2", "prefix", F.inline(both))
    wide = F.col("class") >= WIDE_CLASS
    words = [F.when(wide, F.col("bits").bitwiseXOR(F.col("bits2"))).otherwise(F.col("bits")).alias("bits"), F.when(wide, F.col("bits2")).otherwise(F.lit(0).cast("long")).alias("bits2")]
    rows = classed.select("u", "n", *words, "class", "first", "prefix", F.posexplode(F.slice("prefix", F.lit(1), F.col("first"))).alias("pos", "token"))
    later = F.slice("prefix", F.col("pos") + 2, F.col("first") - F.col("pos"))
    return rows.select(F.xxhash64("token", "class").alias("key"), "u", "n", "bits", "bits2", "pos", "token", later.alias("later"))


def sets_of(some: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, keys) of the sets in some (u); places: (u, own), own the place of each set.

    Sets are built again for these lines only; a fixed-size bitmap of their documents keeps most other texts from moving.
    """
    wanted = places.join(grown(some), "u").groupBy(F.col("own.id").alias("d_id"), F.col("own.h").alias("d_h")).agg(F.collect_list(F.struct("own.no", "u")).alias("at"))
    wanted = materialise(wanted, "wanted")
    near = rows.where(may_hold(wanted, "d_h")(F.col("h")))
    texts = near.join(grown(wanted), near["id"].eqNullSafe(wanted["d_id"]) & (near["h"] == wanted["d_h"]))
    chosen = texts.select(F.split("text", "\n").alias("all"), "at").select(F.transform("at", lambda x: F.struct(x["u"].alias("u"), F.get("all", x["no"]).alias("line"))).alias("some"))
    sets = chosen.select(F.inline("some")).select("u", hashed(F.col("line")).alias("keys"))
    sets = materialise(sets.groupBy("u").agg(F.first("keys").alias("keys")), "sets")  # a repeated row gives its lines again
    drop(wanted)
    return sets


def alike(x: str, y: str) -> Column:
    """Whether two token sets reach the similarity."""
    common = F.size(F.array_intersect(x, y))
    return common * DENOMINATOR >= (F.size(x) + F.size(y) - common) * NUMERATOR


def verified(pairs: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """(u) of the a sides whose token set is similar to that of b."""
    sets = sets_of(pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct(), places, rows)
    both = pairs.join(grown(sets.select(F.col("u").alias("a"), F.col("keys").alias("x"))), "a").join(grown(sets.select(F.col("u").alias("b"), F.col("keys").alias("y"))), "b")
    found = materialise(both.where(alike("x", "y")).select(F.col("a").alias("u")).distinct(), "found")
    drop(sets)
    return found


ROW = ["key", "u", "n", "bits", "bits2", "pos"]


def before() -> list[Column]:
    """y is a line of x's group that stands before x and passes the filters."""
    return [F.col("x.key") == F.col("y.key"), F.col("y.u") < F.col("x.u"), may_match("x", "y")]


def asking_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of lines not found that have such a line before them.

    Rows are kept or not, never paired: however many lines a group has, no step has more rows than it reads.
    """
    asking = rows.alias("x").join(grown(rows).alias("y"), before(), "left_semi")
    return materialise(asking.join(grown(found), "u", "left_anti").select(*ROW), "asking")


def candidates(sets: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asking_lines of all groups, and the lines before them that they ask for."""
    rows = groups(sets)
    # only a token that occurs so often can have so many prefixes
    often = F.shiftright("token", _HASH_BITS) >= _class(F.lit(MANY_PREFIXES))
    frequent = materialise(rows.where(often).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= MANY_PREFIXES).select("key"), "frequent")
    some, parts = not frequent.isEmpty(), []
    in_many = may_hold(frequent, "key") if some else None

    def two(rows: DataFrame) -> DataFrame:
        many = rows.where(in_many(F.col("key"))).join(grown(frequent), "key", "left_semi")
        return many.select(*ROW, F.explode("later").alias("token2")).withColumn("key", F.xxhash64("key", "token2")).select(*ROW)

    for turn in range(TURNS):
        mine = rows.where(F.pmod("token", F.lit(TURNS)) == turn)
        few = mine.select(*ROW)
        parts.append(asking_lines(few.join(grown(frequent), "key", "left_anti") if some else few, found))
        if some:
            parts.append(asking_lines(two(mine), found))
    asking = reduce(DataFrame.unionByName, parts)
    every = rows.select(*ROW).unionByName(two(rows)) if some else rows.select(*ROW)
    near = every.where(may_hold(asking, "key")(F.col("key")))
    asked = materialise(near.alias("y").join(grown(asking).alias("x"), before(), "left_semi").select(*ROW), "asked")
    drop(frequent)
    return asking, asked


def followers(asking: DataFrame, asked: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """(u) of the asking lines whose token set is similar to that of an asked one of their group before them."""
    sets = sets_of(asking.select("u").unionByName(asked.select("u")).distinct(), places, rows)
    whole = lambda side: side.join(grown(sets), "u")
    met = grown(whole(asking)).alias("x").join(grown(whole(asked)).alias("y"), [*before(), alike("x.keys", "y.keys")], "left_semi")
    found = materialise(met.select("u").distinct(), "followers")
    drop(sets)
    return found


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d_id, d_h, kept): for each document with any, the places of lines that no earlier line is similar to."""
    rows = numbered(docs, id_col, text_col)
    ranked = line_sets(token_sets(rows), rarity(rows))
    own = F.struct(F.col("id").isNull().alias("nul"), "id", "h", "no").alias("own")
    firsts = ranked.select("s1", "s2", own, "n", "prefix", "bits", "bits2").groupBy("s1", "s2").agg(F.min("own").alias("own"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "bits2")])
    sets = materialise(firsts.repartitionByRange("own").sortWithinPartitions("own").select(F.monotonically_increasing_id().alias("u"), "own", "n", "prefix", "bits", "bits2"), "firsts")
    places = sets.select("u", "own")

    led = leaders(sets)
    found = verified(led, places, rows)
    drop(led)
    asking, asked = candidates(sets, found)
    more = followers(asking, asked, places, rows)
    drop(asking), drop(asked)
    found = found.unionByName(more)
    kept = places.join(grown(found), "u", "left_anti")
    out = materialise(kept.groupBy(F.col("own.id").alias("d_id"), F.col("own.h").alias("d_h")).agg(F.collect_set("own.no").alias("kept")), "kept")
    drop(found), drop(sets)
    return out


def with_removed(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows of (id, h, lines, ...) with removed: the places of lines with a token that are not kept, ascending."""
    worded = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.char_length(F.trim(F.get("lines", i))) >= LEAST_CHARS)
    out = rows.withColumn("worded", worded).drop("lines").join(grown(kept), rows["id"].eqNullSafe(kept["d_id"]) & (rows["h"] == kept["d_h"]), "left")
    return out.withColumn("removed", F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))).drop("d_id", "d_h", "kept", "worded")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, removed (places of removed lines from 0, ascending).

    A line (between line feeds) with at least one token is removed if an earlier line has a Jaccard similarity of at least
    NUMERATOR / DENOMINATOR to it, however short it is; blank lines stay; tokens are what stands between blanks, in lower case, each counted once.  Earlier
    is by document id (nulls last), then place.  Rows with equal id and text are one document: they lose the same lines.  Of
    different texts with one id, the smaller text hash goes first.  A null text is an empty one: one line, none removed.
    Other columns are ignored, whatever their names.
    """
    rows = numbered(docs, id_col, text_col).select("id", "h", F.split("text", "\n").alias("lines")).withColumn("n_lines", F.size("lines").cast("long"))
    out = with_removed(rows, kept_lines(docs, id_col, text_col))
    return out.select(F.col("id").alias(id_col), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the lines of line_report; texts that lose none stay as they are, null ones too."""
    kept = kept_lines(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("lines"))
    out = with_removed(rows, kept)
    lines_of = F.split(F.col("row")[text_col], "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), "removed"), lambda i: F.get(lines_of, i))
    cut = F.when(F.size("removed") == 0, F.col("row")[text_col]).otherwise(F.array_join(left, "\n"))
    return out.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
