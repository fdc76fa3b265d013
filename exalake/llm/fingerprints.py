"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A paragraph is a line; a long one is cut at the first sentence end after PARAGRAPH_CHARS characters.  Each distinct paragraph
is one number: a digest and a check of that digest.  A sketch adds numbers up in cells (bit by bit, without carry), each
number in one cell of each of three tables.  Two sketches subtract cell by cell, which leaves the paragraphs that differ;
peeling takes out cells whose sum is one number (the check tells) until none is left, and so recovers the differing digests.
If that fails, both texts are sketched larger: numbers are dealt by their first bits to as many sketches as their number asks
for, then to 4 and 16 times as many, with other bits for the cells; at last to a sketch for each digest, which always peels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters after which a paragraph ends with its sentence, and the most that its last sentence adds.
PARAGRAPH_CHARS, SENTENCE_CHARS = 120, 400
TABLES, CELLS = 3, 8
#: On failure numbers are dealt to sketches of about so many each, then to 4 times as many sketches, and so on.
PER_SKETCH = 6
RETRIES = 3
ROUNDS = 16
#: A number is a digest of 40 bits and a check of 24 bits.
DIGEST_BITS, CHECK_BITS = 40, 24


def _shift(turn: int) -> list[int]:
    """Which bits of a number give its cell in each table, other ones in each turn."""
    return [CHECK_BITS + 3 * (TABLES * (turn % 3) + t) for t in range(TABLES)]


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row (a name within a higher-order function is not)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(long((1 << CHECK_BITS) - 1))


def digests(text: Column) -> Column:
    """The distinct numbers of the paragraphs of a text (outer blanks off)."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH_CHARS}}}+[^.!?\n]{{0,{SENTENCE_CHARS}}}+[.!?]*+"), F.lit(0))
    digest = lambda p: F.shiftright(F.xxhash64(F.trim(p)), 64 - DIGEST_BITS)
    return F.transform(F.array_distinct(F.transform(pieces, digest)), lambda d: F.shiftleft(d, CHECK_BITS).bitwiseOR(check(d)))


def _xor(values: Column, start: Column) -> Column:
    return F.aggregate(values, start, lambda acc, x: acc.bitwiseXOR(x))


def _tables(numbers: Column, start: Callable[[int, Column], Column], turn: int) -> Column:
    """Every cell of every table: start(table, place) and the sum of the numbers that fall in it."""

    def table(t: int, shift: int) -> Column:
        mask = long((CELLS - 1) << shift)
        places = F.array(*[long(v << shift) for v in range(CELLS)])
        return F.transform(places, lambda v, i: _xor(F.filter(numbers, lambda x: x.bitwiseAND(mask) == v), start(t, i)))

    return F.concat(*[table(t, shift) for t, shift in enumerate(_shift(turn))])


def cells(numbers: Column, turn: int = 0) -> Column:
    """The sketch of numbers: TABLES * CELLS sums.  Of the numbers of two texts together it is the difference of theirs."""
    return _tables(numbers, lambda t, i: long(0), turn)


def _peel_once(state: Column, turn: int) -> Column:
    """Take every number that is alone in a cell out of all its cells; not live any more once there is none."""

    def alone(y: Column) -> Column:
        return (y != 0) & (y.bitwiseAND(long((1 << CHECK_BITS) - 1)) == check(F.shiftright(y, CHECK_BITS)))

    def without(pure: Column) -> Column:
        after = _tables(pure, lambda t, i: F.get(state["cells"], i + t * CELLS), turn)
        return F.struct(F.lit(True).alias("live"), after.alias("cells"), F.concat(state["found"], pure).alias("found"))

    stop = F.struct(F.lit(False).alias("live"), state["cells"].alias("cells"), state["found"].alias("found"))
    return let(F.array_distinct(F.filter(state["cells"], alone)), lambda pure: F.when(F.size(pure) == 0, stop).otherwise(without(pure)))


def peel(sketch: Column, turn: int = 0) -> Column:
    """(ok, found): whether all was recovered, and the numbers."""
    start = F.struct(F.lit(True).alias("live"), sketch.alias("cells"), F.array().cast("array<long>").alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(~s["live"], s).otherwise(_peel_once(s, turn)))
    return let(end, lambda s: F.struct(F.forall(s["cells"], lambda y: y == 0).alias("ok"), s["found"].alias("found")))


def _peel_each(runs: Column, turn: int) -> Column:
    return F.transform(runs, lambda run: peel(cells(run, turn), turn))


def dealt(numbers: Column, bits: Column) -> Column:
    """Sorted numbers in runs of equal first bits: what goes to one of 2^bits sketches (bits at least 1)."""
    head = lambda x: F.call_function("shiftright", x, 64 - bits)
    at = F.filter(F.sequence(F.lit(0), F.size(numbers) - 1), lambda i: (i == 0) | (head(F.get(numbers, i)) != head(F.get(numbers, i - 1))))
    return let(at, lambda s: F.transform(s, lambda i, j: F.slice(numbers, i + 1, F.coalesce(F.get(s, j + 1), F.size(numbers)) - i)))


def add_likeness(rows: DataFrame, name: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """rows with column `name`: the share of common paragraphs among all of two texts, and `name`_digests: those that differ.

    a and b are columns of numbers, cells_a and cells_b those of their sketches.  `name`_turn tells which sketch peeled: 0 for
    the fingerprint's own.  Texts without paragraphs are alike (1.0).
    """
    got, both, bits, turn = f"{name}__got", f"{name}__both", f"{name}__bits", f"{name}_turn"
    rows = rows.withColumn(got, peel(F.zip_with(cells_a, cells_b, lambda x, y: x.bitwiseXOR(y))))
    rows = rows.withColumn(turn, F.when(F.col(f"{got}.ok"), 0)).withColumn(both, F.when(~F.col(f"{got}.ok"), F.sort_array(F.concat(a, b))))
    total = lambda xs: F.struct(F.forall(xs, lambda x: x["ok"]).alias("ok"), F.flatten(F.transform(xs, lambda x: x["found"])).alias("found"))
    rows = rows.withColumn(bits, F.greatest(F.ceil(F.log2((F.size(a) + F.size(b)) / PER_SKETCH)).cast("int"), F.lit(1)))
    for retry in range(RETRIES + 1):
        wider = F.least(F.col(bits) + 2 * retry, F.lit(DIGEST_BITS)) if retry < RETRIES else F.lit(DIGEST_BITS)
        larger = let(_peel_each(dealt(F.col(both), wider), retry + 1), total)
        rows = rows.withColumn(got, F.when(F.col(f"{got}.ok"), F.col(got)).otherwise(larger))
        rows = rows.withColumn(turn, F.coalesce(turn, F.when(F.col(f"{got}.ok"), retry + 1)))
    differ = F.size(f"{got}.found")
    # |a| + |b| is twice the common paragraphs and the others once
    union = (F.size(a) + F.size(b) + differ) / 2
    rows = rows.withColumn(f"{name}_digests", F.transform(f"{got}.found", lambda x: F.shiftright(x, CHECK_BITS)))
    return rows.withColumn(name, F.when(union == 0, F.lit(1.0)).otherwise((union - differ) / union)).drop(got, both, bits)


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its sums in hexadecimal."""
    return F.array_join(F.transform(sketch, lambda y: F.hex(y)), ".")


def followers(keys: DataFrame) -> DataFrame:
    """(id, h, next_id, next_h): the next key of each in descending order (ids, then h; null ids last), the first after the last.

    Keys are dealt by range and looked up within a range; only the first key of each range is looked at across ranges.
    """
    order = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    ranged = keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    own = Window.partitionBy("range").orderBy(*order)
    placed = ranged.select("id", "h", "range", F.row_number().over(own).alias("place"), F.lead(F.struct("id", "h")).over(own).alias("next"))
    across = Window.orderBy("range")
    heads = placed.where("place = 1").select("range", F.struct("id", "h").alias("head"))
    heads = heads.select("range", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("after"))  # a row a range
    found = placed.join(F.broadcast(heads), "range").select("id", "h", F.coalesce("next", "after").alias("next"))
    return found.select("id", "h", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def with_next(docs: DataFrame, id_col: str, text_col: str, share: int = 3) -> DataFrame:
    """(id, h, text, prefix, next_digests): of the next document the first floor(n_chars / share) characters and the digests.

    Only these travel: each document sends them once, to the one document that it follows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.char_length(text).alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"))
    chain = followers(keys.select("id", "h"))
    orders = chain.join(keys.withColumnsRenamed({"id": "kid", "h": "kh"}), F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")))
    orders = orders.select(F.col("next_id").alias("from_id"), F.col("next_h").alias("from_h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / share).cast("int").alias("need"))
    sent = rows.join(orders, F.col("id").eqNullSafe(F.col("from_id")) & (F.col("h") == F.col("from_h")))
    sent = sent.select("to_id", "to_h", F.substring("text", F.lit(1), F.col("need")).alias("prefix"), digests(F.col("text")).alias("next_digests"))
    sent = sent.groupBy("to_id", "to_h").agg(F.first("prefix").alias("prefix"), F.first("next_digests").alias("next_digests"))  # a repeated row sends again
    return rows.join(sent, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h"))).select("id", "text", "prefix", "next_digests")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and

    near_edited_digests, the digests of paragraphs that only one of text and edited text has, and the sketch that told each
    likeness (near_edited_turn, near_next_turn: 0 the fingerprints' own, then the larger ones).

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many (or all) of the next document in
    descending order of ids, after the last the first.  A null text is an empty one.  Rows with equal id and text are one
    place in that order and get the same result each; of equal ids the larger hash of the text goes first; null ids come
    last.  A lone document is its own next.  Other columns are ignored.
    """
    n = F.char_length("text")
    rows = with_next(docs, id_col, text_col).select("id", "text", "next_digests", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.col("prefix")).alias("edited"))
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), F.col("next_digests").alias("b"))
    rows = rows.withColumns({"ca": cells(F.col("a")), "ce": cells(F.col("e")), "cb": cells(F.col("b"))})
    rows = add_likeness(add_likeness(rows, "near_edited", "a", "e", "ca", "ce"), "near_next", "a", "b", "ca", "cb")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("ca")).alias("fingerprint"), fingerprint(F.col("ce")).alias("edited_fingerprint"), "near_edited", "near_next", "near_edited_digests", "near_edited_turn", "near_next_turn")
