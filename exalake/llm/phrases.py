"""Collocations by pivot partitioning: each n-gram is counted where its rarest word is mined.

Words are ranked by how often they occur (per language).  Around each word occurrence the text is rewritten to a fragment: what
stands beside it without a rarer word (or an edge of the piece) in between.  A fragment is routed to its pivot, the word that it
was cut around, equal fragments are added up before they move, and there all n-grams of the fragment that hold the pivot's
place are counted.  The pivot of an n-gram is the leftmost of its rarest words, so every occurrence is counted in one fragment.
The fragments of a frequent pivot are dealt by their text to as many groups as its count asks for, and the groups' counts are
added up.

Any fixed order of words gives the same counts; the ranks only balance the load.  So exact counts are looked up for the most
frequent words, as many as fit in a table of fixed size, and all others are rarer than those and ordered by a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.llm.text_arrays import _LOWER, byte_slices, drop, materialise, mix, prefix_hashes, span_hashes, utf8

MIN_COUNT, MOST_WORDS, TOP = 10, 3, 2000
#: A phrase goes if one that holds it occurs at least this often for each hundred of its own occurrences.
INSIDE_PERCENT = 50
#: Bounds of the rank table, which every task gets.
RANKED_WORDS, RANKED_BYTES = 1 << 17, 8 << 20
#: Occurrences of a pivot that one group of its fragments stands for, on average.
GROUP = 20_000
#: Bytes of text that one numpy pass handles, and rows that are added up in a task before they move.
SLICE_BYTES = 1 << 18
COMBINE_ROWS = 1 << 18
#: Partitions of the mined fragments for each of the session's shuffle partitions: about so many n-grams come of a fragment.
MINED_PARTITIONS = 4
#: Groups in which a language's first rows are chosen before they meet.
TOP_GROUPS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[ord(" "), ord("\t")]] = True


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes in lower case, offsets, lang of each row) of about SLICE_BYTES; a longer text is cut where pieces end."""
    for batch in byte_slices(batches, "text", SLICE_BYTES):
        data, offsets = utf8(batch.column("text"))
        low, lang = _LOWER[data], batch.column("lang")
        if batch.num_rows > 1 or len(low) <= 2 * SLICE_BYTES:
            yield low, offsets, lang
            continue
        ends, at = np.flatnonzero(_BREAK[low]), 0
        while at < len(low):
            k = int(np.searchsorted(ends, at + SLICE_BYTES))
            k -= k > 0 and k - 1 < len(ends) and ends[k - 1] >= at
            stop = int(ends[k]) + 1 if k < len(ends) else len(low)
            yield low[at:stop], np.array([0, stop - at]), lang
            at = stop


class _Words:
    """Words of a slice: row, piece (numbered through), and their bytes on end with one blank after each (text, at, size)."""

    def __init__(self, low: np.ndarray, offsets: np.ndarray):
        inside = ~_APART[low]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(low))]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[edge] = inside[edge]
        stop[:-1] &= ~inside[1:]
        stop[edge - 1] = inside[edge - 1]
        start, self.size = np.flatnonzero(begin), np.flatnonzero(stop) + 1 - np.flatnonzero(begin)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        self.piece = np.cumsum(_BREAK[low])[start] + self.row
        self.at = np.cumsum(self.size + 1) - self.size - 1
        self.text = np.full(int((self.size + 1).sum()), 32, np.uint8)
        within = _within(self.size)
        self.text[np.repeat(self.at, self.size) + within] = low[np.repeat(start, self.size) + within]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each of several runs."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _strings(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow string array."""
    data = text[np.repeat(at, sizes) + _within(sizes)]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data))


def _combined(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that agree in all but n, added up, each time COMBINE_ROWS have come together."""

    def total() -> list[pa.RecordBatch]:
        keys = [c for c in held[0].schema.names if c != "n"]
        table = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(held[0].schema.names).to_batches(max_chunksize=1 << 16)

    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= COMBINE_ROWS:
            yield from total()
            held, rows = [], 0
    if rows:
        yield from total()
    held = []
    pa.default_memory_pool().release_unused()  # the worker waits for its next task beside those of other stages


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for low, offsets, lang in _slices(batches):
            w = _Words(low, offsets)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(w.row)), _strings(w.text, w.at, w.size), pa.array(np.ones(len(w.at), np.int64))], ["lang", "word", "n"])

    yield from _combined(parts())


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, f) over all texts."""
    found = _texts(docs, lang_col, text_col).mapInArrow(_count_words, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _lang_hashes(langs: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(langs, pa.string()))
    return span_hashes(prefix_hashes(data), offsets[:-1], offsets[1:])


class Ranks:
    """The rank table: sorted hashes of (lang, word), their ranks (0 the most frequent) and, by rank, their counts.

    complete: every word of at least min_count is in it, so what isn't in it is in no candidate.
    """

    def __init__(self, words: list[tuple[str, str, int]], complete: bool):
        words = sorted(words, key=lambda w: (-w[2], w[0], w[1]))
        data, offsets = utf8(pa.array([w[1] for w in words], pa.string()))
        hashes = self.key(span_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]), _lang_hashes([w[0] for w in words]))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts, self.complete = hashes[self.order], np.array([w[2] for w in words], np.int64), complete

    @staticmethod
    def key(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
        return mix(words ^ mix(langs, 7))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rarity, known): the rank, or a number beyond all ranks."""
        rarity = keys | np.uint64(1 << 63)
        if not len(self.hashes):
            return rarity, np.zeros(len(keys), bool)
        spot = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        known = self.hashes[spot] == keys
        rarity[known] = self.order[spot[known]].astype(np.uint64)
        return rarity, known


def ranks(counts: DataFrame, min_count: int = MIN_COUNT, most_words: int = RANKED_WORDS, most_bytes: int = RANKED_BYTES) -> Ranks:
    """The most frequent words (of min_count at least), down to a class of counts such that all fit in both bounds."""
    level = F.floor(F.log2("f") * 8)
    frequent = counts.where(F.col("f") >= min_count).withColumn("level", level)
    sizes = frequent.groupBy("level").agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + F.octet_length("lang")).alias("bytes")).collect()  # 8 * 63 rows at most
    words, size, least = 0, 0, None
    for r in sorted(sizes, key=lambda r: -r.level):
        words, size = words + r.words, size + r.bytes
        if words > most_words or size > most_bytes:
            break
        least = r.level
    complete = words <= most_words and size <= most_bytes
    rows = frequent.where(F.col("level") >= least).select("lang", "word", "f").collect() if least is not None else []
    return Ranks([tuple(r) for r in rows], complete)


FRAGMENTS = "lang string, pivot long, part int, place int, fragment string, n long"


def _rewrite(table: Ranks, most: int, group: int):
    def fragments(low: np.ndarray, offsets: np.ndarray, lang: pa.Array) -> pa.RecordBatch:
        w = _Words(low, offsets)
        running = prefix_hashes(w.text)
        keys = Ranks.key(span_hashes(running, w.at, w.at + w.size), _lang_hashes(lang.to_pylist())[w.row])
        rarity, known = table.of(keys)
        usable = known if table.complete else np.ones(len(known), bool)
        linked = np.zeros(len(keys), bool)  # with the next word
        linked[:-1] = (w.piece[1:] == w.piece[:-1]) & usable[1:] & usable[:-1]
        left, right = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        goes_left, goes_right = np.ones(len(keys), bool), np.ones(len(keys), bool)
        for j in range(1, min(most, len(keys))):
            goes_left[:j] = False
            goes_left[j:] &= linked[:-j] & (rarity[:-j] < rarity[j:])
            goes_right[-j:] = False
            goes_right[:-j] &= linked[j - 1 : -1] & (rarity[j:] <= rarity[:-j])
            left += goes_left
            right += goes_right
        own = np.flatnonzero(left + right)
        first, last = own - left[own], own + right[own]
        start, end = w.at[first], w.at[last] + w.size[last]
        groups = np.ones(len(own), np.int64)
        ranked = known[own]
        groups[ranked] += table.counts[rarity[own[ranked]].astype(np.int64)] // group
        part = np.where(groups > 1, (span_hashes(running, start, end) % groups.astype(np.uint64)).astype(np.int64), -1)
        columns = [lang.take(pa.array(w.row[own])), pa.array(keys[own].view(np.int64)), pa.array(part.astype(np.int32)), pa.array(left[own].astype(np.int32)), _strings(w.text, start, end - start)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(own), np.int64))], ["lang", "pivot", "part", "place", "fragment", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined(fragments(*x) for x in _slices(batches))

    return run


def fragments(docs: DataFrame, table: Ranks, most: int = MOST_WORDS, group: int = GROUP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Fragments with the hash of their pivot, its place among the words, and how often they stand; part is the group of
    fragments of a frequent pivot, else -1."""
    return _texts(docs, lang_col, text_col).mapInArrow(_rewrite(table, most, group), FRAGMENTS)


def mined(routed: DataFrame, most: int = MOST_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, a): the n-grams of 2 to `most` words that hold the pivot's place, counted where the pivot is."""
    words = F.split("fragment", " ")
    place = F.col("place")

    def ngram(left: int, right: int) -> Column:
        return F.when((place >= left) & (place + right < F.size("words")), F.array_join(F.slice("words", place - left + 1, F.lit(left + right + 1)), " "))

    each = F.array(*[ngram(left, right) for left in range(most) for right in range(most - left) if left + right])
    here = routed.withColumn("words", words).select("lang", "pivot", "part", "n", F.explode(each).alias("phrase")).where("phrase IS NOT NULL")
    local = here.groupBy("lang", "pivot", "part", "phrase").agg(F.sum("n").alias("a")).where((F.col("part") >= 0) | (F.col("a") >= min_count))
    return local.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)


def candidates(docs: DataFrame, counts: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, most: int = MOST_WORDS, group: int = GROUP, ranked: int = RANKED_WORDS) -> DataFrame:
    """(lang, phrase, a) of all phrases of 2 to `most` words that occur min_count times."""
    found = fragments(docs, ranks(counts, min_count, ranked), most, group, lang_col, text_col)
    parts = MINED_PARTITIONS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mined(found.repartition(parts, "lang", "pivot", "part"), most, min_count)


def scored(found: DataFrame, counts: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """found with l, r and score of the lowest-scoring cut, the smallest k of equal ones."""
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cut = lambda k: F.when(F.size("words") > k, F.struct(F.lit(k).alias("k"), part(F.lit(1), F.lit(k)).alias("first"), part(F.lit(k + 1), F.size("words") - k).alias("rest")))
    cuts = found.withColumn("words", F.split("phrase", " ")).select("lang", "phrase", "a", F.explode(F.array(*[cut(k) for k in range(1, most)])).alias("cut")).where("cut IS NOT NULL")
    known = counts.select("lang", F.col("word").alias("phrase"), "f").unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
    known = lambda name, f, known=known: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.select("lang", "phrase", "a", "cut.*").join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    both = both.withColumn("score", F.expr("CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(15,0)) * 1000000BD DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def without_inner(rows: DataFrame, found: DataFrame, most: int = MOST_WORDS, percent: int = INSIDE_PERCENT) -> DataFrame:
    """rows without those phrases that stand inside a longer one of `found` that occurs often enough."""
    words = found.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    spot = [(start, size) for size in range(2, most) for start in range(1, most - size + 2)]
    inner = [F.when((F.size("words") > size) & (F.size("words") >= start + size - 1), F.array_join(F.slice("words", start, size), " ")) for start, size in spot]
    if not inner:
        return rows
    longest = words.select("lang", "a", F.explode(F.array(*inner)).alias("phrase")).where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = rows.join(longest, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def first_rows(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rank: 1, 2, ... within a language by score, a (both descending) and phrase, up to `top`; first within groups of phrases."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(TOP_GROUPS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top).drop("g")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, most: int = MOST_WORDS, top: int = TOP, group: int = GROUP, ranked: int = RANKED_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Texts are split at [.,;:!?] and line ends into pieces, those at blanks and tabs into words; A-Z are lower-cased, nothing
    else.  A null text is an empty one, a null lang is `und`.  Repeated rows count as often as they stand.  Equal scores go by
    a, then by the phrase's bytes.  Languages without a phrase of min_count, and empty tables, give no rows.  Other columns are
    ignored.  Whole texts are read; a long one is worked on in slices that end with a piece, so one piece is held at once.
    """
    counts = materialise(word_counts(docs, lang_col, text_col), "words")
    found = materialise(candidates(docs, counts, lang_col, text_col, min_count, most, group, ranked), "phrases")
    rows = without_inner(scored(found, counts.where(F.col("f") >= min_count), most), found, most)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    result = materialise(first_rows(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop(counts)
    drop(found)
    return result


#: The same rows from plain counts of all n-grams.
PHRASES_SQL = """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, text FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents)),
words AS (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT lang, piece, list_filter(string_split_regex(text, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces)),
runs AS (SELECT lang, w, lead(w) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM words),
grams AS (
  SELECT lang, 1 AS m, w AS phrase FROM runs UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c, (VALUES (1), (2)) AS s(k)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ') WHERE k < c.m),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best AS b JOIN n USING (lang) LEFT JOIN inner_of AS i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
"""
