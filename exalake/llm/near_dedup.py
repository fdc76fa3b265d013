"""Near-duplicates by Order MinHash and banded alignment.

A document is the sequence of its word k-mers, each labelled with its occurrence.  For every hash function the sketch takes
the few least labelled k-mers and keeps their order in the text, so equal sketches speak for small edit distance and not
just for common words.  Documents with an equal sketch are candidates; a banded alignment of their words decides.  Exact
copies are one node from the start.  Classes are the connected components of the verified links.

A bucket of equal sketches is not spread into its pairs.  Each document meets the centre of its widest bucket first, one
pair a document, and only members of a bucket that links don't connect by then go on: they meet the bucket's own centre, and
what is still not connected meets by its rare words, of which similar documents share one.  Pairs
whose lengths or word parities rule similarity out are never made; all bounds are exact.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.llm.text_arrays import Words, byte_slices, drop, lower_bytes, materialise, may_hold, mix, prefix_hashes, shingles, span_hashes, utf8

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Hash functions, and labelled k-mers that a sketch takes of each.  At the threshold itself (a fifth of the words replaced
#: here and there) a pair shares a sketch with a chance of about 0.9, at a tenth replaced of almost 1.
SKETCHES, PER_SKETCH = 64, 2
#: Buckets of at most so many are paired outright as soon as they meet their centre.
SMALL = 4
#: Later, buckets of at most so many are; members of larger ones meet by their rare words.
PAIRED_OUTRIGHT = 8
#: Edits that are looked for along single diagonals; beyond them the whole band goes at once.
SCALAR_EDITS = 6
#: Words of a document's parity filter, 64 bits each.
PARITY_WORDS = 16
PARITY = [f"parity{i}" for i in range(PARITY_WORDS)]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case) of a text column, and each row's first word (one entry more)."""
    data, offsets = utf8(column)
    low = lower_bytes(data)
    words = Words(low, offsets)
    return span_hashes(prefix_hashes(low), words.start, words.end), words.first


def order_min_hash(words: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, take: int = PER_SKETCH, k: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of sketches for each document; documents without words have none (zeros)."""
    grams, begin = shingles(words, first, k)
    n = len(begin) - 1
    out = np.zeros((n, sketches), np.uint64)
    full = np.flatnonzero(np.diff(begin) > 0)
    if not len(full):
        return out
    doc = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((grams, doc))
    g, d = grams[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))
    at = np.arange(len(g))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    label = np.empty(len(g), np.uint64)
    label[order] = nth.astype(np.uint64)
    grams = grams + label * np.uint64(0x9E3779B97F4A7C15)
    starts = begin[:-1][full]
    size = np.diff(begin)[full]
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64), 5)
    odd = mix(seeds, 6) | np.uint64(1)
    for s in range(sketches):
        h = (grams ^ seeds[s]) * odd[s]  # the order of the products' high bits
        places, kept = [], []
        for j in range(take):
            least = np.minimum.reduceat(h, starts)
            hit = np.flatnonzero(h == np.repeat(least, size))
            row = np.searchsorted(starts, hit, side="right") - 1
            one = np.append(True, row[1:] != row[:-1])
            hit = hit[one]  # labelled k-mers differ, so equal hashes are the exhausted rows only
            places.append(hit)
            kept.append(np.where(least == ~np.uint64(0), np.uint64(0), grams[hit]))
            if j + 1 < take:
                h[hit] = ~np.uint64(0)
        where, what = np.stack(places, 1), np.stack(kept, 1)
        what = np.take_along_axis(what, np.argsort(np.where(what == 0, np.int64(2**62), where), axis=1, kind="stable"), 1)
        value = np.full(len(full), s + 1, np.uint64)
        for j in range(take):
            value = mix(value * np.uint64(0x100000001B3) + what[:, j], 3)
        out[full, s] = value
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two word sequences if at most limit, else limit + 1.

    Only diagonals within the band are followed, each from its furthest point (the distance grows by one a round).
    """
    short = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:short] == b[:short], False)))
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    tail = int(np.argmin(np.append((a[len(a) - short :] == b[len(b) - short :])[::-1], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > limit:
        return min(max(n, m), limit + 1)
    ends: dict[int, list[int]] = {}

    def slide(t: int, k: int) -> int:
        """Along diagonal k from place t of a to the next mismatch."""
        stops = ends.get(k)
        if stops is None:
            lo, hi = max(0, -k), min(n, m - k)
            stops = ends[k] = [*(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo).tolist(), hi] if hi > lo else [max(hi, lo)]
        return stops[bisect.bisect_left(stops, t)] if t <= stops[-1] else t

    goal = m - n
    reach = {0: slide(0, 0)}
    e = 0
    while e <= min(limit, SCALAR_EDITS):
        if reach.get(goal, -1) >= n:
            return e
        e += 1
        nxt = {}
        for k in range(max(-e, -n), min(e, m) + 1):
            t = max(reach.get(k - 1, -1), reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1)
            if t >= 0:
                t = min(t, n, m - k)
                nxt[k] = slide(t, k) if 0 <= t + k < m and t < n else t
        reach = nxt
    return banded_bits(a, b, limit) if e <= limit else limit + 1


def banded_bits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """banded_distance by bit vectors: one bit a row of the band, one step a column of the alignment."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    k = min(limit, n)
    if n - m > limit:
        return limit + 1
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    every, top = (1 << 2 * k + 1) - 1, 1 << 2 * k
    plus, minus = every ^ ((1 << k) - 1), 0  # vertical differences of the column before, within the band's rows
    score = k  # the band's last row, later the last row of all
    for j, word in enumerate(b.tolist(), 1):
        shift = j - k - 1
        same = places.get(word, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & every
        level = ((((same & plus) + plus) ^ plus) | same | minus) & every
        right, left = minus | (every ^ (level | plus) & every), level & plus
        if j <= n - k:
            score += not level & top
        else:
            row = 1 << n - j + k
            score += bool(right & row) - bool(left & row)
        if score > limit + (m - j) + k:
            return limit + 1
        plus, minus = (left | (every ^ ((level >> 1) | right))) & every, (level >> 1) & right
    return min(score, limit + 1)


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """What the word counts alone say: never more than the edit distance."""
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = inverse.max() + 1
    diff = np.bincount(inverse[: len(a)], minlength=size) - np.bincount(inverse[len(a) :], minlength=size)
    return int(max(diff[diff > 0].sum(), -diff[diff < 0].sum()))


def word_parity(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the parities of how often words of each hash class occur: PARITY_WORDS columns of 64 bits."""
    n, bits = len(first) - 1, PARITY_WORDS * 64
    out = np.zeros((n, PARITY_WORDS), np.uint64)
    for start in range(0, n, 1024):
        stop = min(n, start + 1024)
        own = (words[first[start] : first[stop]] % np.uint64(bits)).astype(np.int64)
        doc = np.repeat(np.arange(stop - start), np.diff(first[start : stop + 1]))
        odd = np.bincount(doc * bits + own, minlength=(stop - start) * bits) & 1
        out[start:stop] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view(np.uint64)
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least similarity."""
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return max(abs(len(a) - len(b)), bag_distance(a, b)) <= limit and banded_distance(a, b, limit) <= limit


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only for documents that can't be similar: by their lengths, or by the words that one has and the other hasn't.

    Of the latter the longer one has |an - bn| more than the other, and at most as many as there are edits; parities that differ
    are no more than both together.
    """
    an, bn = F.col(f"{a}.n_words"), F.col(f"{b}.n_words")
    limit = (1 - similarity) * F.greatest(an, bn) + 1e-9
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in PARITY[1:]), F.bit_count(F.col(f"{a}.{PARITY[0]}").bitwiseXOR(F.col(f"{b}.{PARITY[0]}"))))
    return (F.abs(an - bn) <= limit) & (differ + F.abs(an - bn) <= 2 * limit)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key): key is the digest of the text; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_words, sketch, parities) of every row."""
    source = keyed(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", 1 << 20):
            words, first = word_hashes(part.column("text"))
            rows, parity = order_min_hash(words, first).view(np.int64), word_parity(words, first).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKETCHES), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(np.diff(first).astype(np.int64)), lists, *[pa.array(parity[:, i]) for i in range(PARITY_WORDS)]], ["id", "key", "n_words", "sketch", *PARITY])

    return source.mapInArrow(run, f"id {kind}, key binary, n_words long, sketch array<long>, {', '.join(f'{w} long' for w in PARITY)}")


def node_words(some: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, words) of the nodes in some (u): the word hashes of their texts, 32 bits each, on end."""
    ends = materialise(nodes.select("u", "key", "least").join(some, "u").select("u", F.col("key").alias("k"), "least", F.xxhash64("key").alias("hash")), "ends")
    near = rows.where(may_hold(ends, "hash")(F.xxhash64("key")))
    texts = near.join(ends, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("least"))).select("u", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", 1 << 20):
            words, first = word_hashes(part.column("text"))
            short = (words >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column("u"), pa.array([short[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["u", "words"])

    return materialise(texts.mapInArrow(run, "u long, words binary").groupBy("u").agg(F.first("words").alias("words")), "words")  # a repeated row gives its words again


def verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose alignment makes them similar."""
    some = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
    words = node_words(some, nodes, rows)
    links = aligned(pairs, words, similarity)
    drop(words)
    return links


def aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """verify with the words (u, words) of all nodes in pairs."""
    both = pairs.join(words.select(F.col("u").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("u").alias("b"), F.col("words").alias("words_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: np.frombuffer(x.as_buffer(), np.uint32)
        for part in batches:
            got = [similar(of(x), of(y), similarity) for x, y in zip(part.column("words_a"), part.column("words_b"), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(got, pa.bool_()))

    return materialise(both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long"), "links")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, u, n, centre): nodes with an equal sketch, n of them, centre the least u.  Lone nodes have no row."""
    members = nodes.select("u", F.posexplode("sketch").alias("at", "value")).select(F.xxhash64("at", "value").alias("bucket"), "u")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("u").alias("centre")).where("n > 1")
    return materialise(members.join(sizes, "bucket"), "members")


def classes_of(members: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, root) of nodes that links connect.  Every pair of a bucket is compared, ruled out by exact bounds, or connected by other links."""
    known = nodes.select("u", "n_words", *PARITY)
    widest = members.groupBy("u").agg(F.max(F.struct("n", (-F.col("centre")).alias("centre"))).alias("widest"))
    star = widest.select((-F.col("widest.centre")).alias("a"), F.col("u").alias("b")).where("a != b")
    sides = star.join(known.withColumnsRenamed({c: f"{c}_a" for c in known.columns}), F.col("a") == F.col("u_a")).join(known.withColumnsRenamed({c: f"{c}_b" for c in known.columns}), F.col("b") == F.col("u_b"))
    side = lambda s: F.struct("n_words_" + s, *[f"{w}_{s}" for w in PARITY]).cast("struct<n_words:long," + ",".join(f"{w}:long" for w in PARITY) + ">").alias(s * 2)
    tried = materialise(sides.select("a", "b", side("a"), side("b")).where(may_be_similar("aa", "bb", similarity)).select("a", "b"), "tried")
    labels = components(verify(tried, nodes, rows, similarity))
    left = apart(members, labels)
    drop(members)
    pairs = materialise(bucket_pairs(left, known, (F.col("n") <= SMALL) | (F.col("u") == F.col("centre")), similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tried.unionByName(pairs)
    labels = merged(labels, verify(pairs, nodes, rows, similarity))
    still = apart(left, labels)
    drop(left)
    if not still.isEmpty():
        words = node_words(still.select("u").distinct(), nodes, rows)
        small = bucket_pairs(still.where(F.col("n") <= PAIRED_OUTRIGHT), known, F.lit(True), similarity)
        large = rare_pairs(still.where(F.col("n") > PAIRED_OUTRIGHT), words, known, similarity)
        rest = materialise(small.unionByName(large).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        labels = merged(labels, aligned(rest, words, similarity))
        drop(words)
    drop(still)
    return labels


def bucket_pairs(members: DataFrame, known: DataFrame, head: Column, similarity: float) -> DataFrame:
    """(a, b): the pairs of members of one bucket and of different roots, one of them a head, that may be similar."""
    full = members.join(known, "u")
    met = full.alias("x").join(full.where(head).alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & may_be_similar("x", "y", similarity))
    return met.select(F.least("x.u", "y.u").alias("a"), F.greatest("x.u", "y.u").alias("b")).distinct()


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, u, root, n, centre): members of those buckets that labels don't connect."""
    placed = members.select("bucket", "u").join(labels, "u", "left").withColumn("root", F.coalesce("root", "u"))
    split = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("u").alias("centre"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    return materialise(placed.join(split.select("bucket", "n", "centre"), "bucket"), "apart")


def word_table(words: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(u, root, n_words, token, first): the words of each node of members, each labelled with its occurrence.

    Similar nodes have all but (1 - similarity) * n words in common, n the longer one's, so they share one of the `first` rarest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for u, root, text in zip(part.column("u"), part.column("root"), part.column("words"), strict=True):
                own = np.sort(mix(np.frombuffer(text.as_buffer(), np.uint32).astype(np.uint64), 7))
                new, at = np.append(True, own[1:] != own[:-1]), np.arange(len(own))
                nth = at - np.maximum.accumulate(np.where(new, at, 0))
                tokens, n = mix(own + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 8), len(own)
                first = n - max(1, math.ceil(n * similarity - 1e-6)) + 1
                same = [pa.array(np.full(n, x, np.int64)) for x in (u.as_py(), root.as_py(), n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(tokens.view(np.int64)), pa.array(np.full(n, first, np.int64))], ["u", "root", "n_words", "token", "first"])

    return words.join(members.select("u", "root").distinct(), "u").select("u", "root", "words").mapInArrow(run, "u long, root long, n_words long, token long, first long")


def rare_pairs(members: DataFrame, words: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs that share one of members' buckets, have different roots and may be similar.

    Nothing is paired by buckets.  All words are put in one order, rare ones first, and only nodes meet that share one of their
    first few, as similar ones do: members of a bucket for one passage don't, unless it is most of their texts.  Words meet by
    roots first, so that a large class isn't paired with itself.
    """
    of = members.groupBy("u").agg(F.collect_set("bucket").alias("own"))
    tokens = materialise(word_table(words, members, similarity), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    order = F.row_number().over(Window.partitionBy("u").orderBy("n", "token"))
    ranked = tokens.join(counts, "token").withColumn("at", order).where("at <= first AND least != most")
    prefix = materialise(ranked.join(known.drop("n_words"), "u").select("token", "root", "u", "n_words", (F.col("n_words") - F.col("at") + 1).alias("rest"), *PARITY), "prefix")
    drop(tokens)
    lone = [F.first(c).alias(c) for c in PARITY]
    roots = prefix.groupBy("token", "root").agg(F.count("*").alias("size"), F.min("n_words").alias("shortest"), F.max("n_words").alias("n_words"), F.max("rest").alias("rest"), *lone)
    longest = similarity * F.greatest("x.shortest", "y.shortest") - 1e-6
    able = (F.col("x.n_words") >= longest) & (F.col("y.n_words") >= longest) & (F.least("x.rest", "y.rest") >= longest)
    single = (F.col("x.size") > 1) | (F.col("y.size") > 1) | may_be_similar("x", "y", similarity)
    sides = roots.alias("x").join(roots.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & able & single)
    sides = sides.select("x.token", F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b"))
    side = lambda s: prefix.select("token", F.col("root").alias("root_" + s), F.col("u").alias(s), F.col("n_words").alias("n_" + s), F.col("rest").alias("rest_" + s))
    within = F.least("n_a", "n_b", "rest_a", "rest_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    right = side("b").withColumnRenamed("token", "token_b").withColumnRenamed("root_b", "of_b")
    both = sides.join(side("a"), ["token", "root_a"]).join(right, (F.col("token") == F.col("token_b")) & (F.col("root_b") == F.col("of_b")) & within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    info = known.join(of, "u")
    met = both.join(info.alias("x"), F.col("a") == F.col("x.u")).join(info.alias("y"), (F.col("b") == F.col("y.u")) & may_be_similar("x", "y", similarity) & F.arrays_overlap("x.own", "y.own"))
    return met.select("a", "b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only the roots that these connect are worked on."""
    ends = links.join(labels.select(F.col("u").alias("a"), F.col("root").alias("root_a")), "a", "left").join(labels.select(F.col("u").alias("b"), F.col("root").alias("root_b")), "b", "left")
    between = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b")
    joined = components(between)
    old = labels.join(joined.select(F.col("u").alias("root"), F.col("root").alias("of_root")), "root", "left").select("u", F.coalesce("of_root", "root").alias("root"))
    return materialise(old.unionByName(joined.join(labels.select("u"), "u", "left_anti")), "labels")


def components(links: DataFrame) -> DataFrame:
    """(u, root) of every node in a link; root is the least node of its component.

    Each node takes the least label among its neighbours', then that label's own label (pointer jumping), until none changes.
    """
    edges = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("root")), "labels")
    while True:
        around = edges.join(labels.select(F.col("u").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(around, labels["u"] == around["a"]).select("u", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("u").alias("root"), F.col("root").alias("of_root"))
        after = materialise(least.join(jump, "root", "left").select("u", "old", F.least("root", F.coalesce("of_root", "root")).alias("root")), "labels")
        drop(labels)
        labels = after.select("u", "root")
        if after.where("old != root").isEmpty():
            drop(edges)
            return labels


def classified(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """near_duplicates with the columns id and key (digest of the text)."""
    table = materialise(sketch_table(docs, id_col, text_col), "sketches")
    worded = table.where("n_words > 0").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_words", "sketch", *PARITY)])
    nodes = materialise(worded.select(F.monotonically_increasing_id().alias("u"), "*"), "nodes")
    members = buckets(nodes)
    labels = classes_of(members, nodes, keyed(docs, id_col, text_col), similarity)
    placed = nodes.select("u", "key", "least", "n").join(labels, "u", "left").withColumn("root", F.coalesce("root", "u"))
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.min_by("key", F.struct(F.col("least").isNull(), "least", "key")).alias("keeper"), F.sum("n").alias("class_size"))
    of_key = placed.select("key", "root", "least").join(classes, "root").select("key", "least", "class_id", "class_size", (F.col("key") == F.col("keeper")).alias("own"))
    out = table.select("id", "key", "n_words").join(of_key, "key", "left")
    alone = F.col("own").isNull() | (F.col("n_words") == 0)
    return out.select(
        "id",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | (F.col("own") & F.col("id").eqNullSafe(F.col("least")))).alias("keep"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, class_id (the least id of its class), class_size (rows), keep (the row is its class's own).

    Two documents are linked if they share a sketch and the edit distance of their words (lower case) is at most
    1 - similarity of the longer one's words; a class is what links connect.  Of several rows with the class's least id,
    texts and ids alike, one is kept.  Null, empty and blank texts are each a class of their own.  A null id counts after all
    others; if a class has no other, class_id is null.  Other columns are ignored, whatever their names.  Documents of fewer
    than about 15 words with a changed word seldom share five words on end, so most such pairs are missed.
    """
    return classified(docs, id_col, text_col, similarity).drop("key").withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, of one document of each class (see near_duplicates).

    Rows alike in id and text are one document: they stay or go together.
    """
    gone = classified(docs, id_col, text_col, similarity).where(~F.col("keep")).select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"))
    left = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
