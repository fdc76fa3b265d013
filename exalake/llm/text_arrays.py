"""Arrow text columns as flat numpy arrays: bytes, word boundaries and word hashes for a whole batch at once."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter that keeps most texts without partners from moving.
FILTER_BITS = 1 << 22
#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, spark.checkpoint.dir.

    Where it is unset, a folder on this machine is taken if everything runs in this one process, and nothing else works.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete a query's shuffle files when the query ends, not when the driver happens to collect garbage.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once (with the writer's options) to the shared folder and read it back: cuts the lineage, survives lost executors.

    Shuffle files that only the writing needed go with it.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_SHUFFLES) if before is None else spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the written table behind a materialised frame that is not needed any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_dir(df.sparkSession, path)


def drop_dir(spark, path: str) -> None:
    """Delete a folder of the shared file system through Hadoop, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def one_bit(x: Column) -> Column:
    """A long with the bit set that the last six bits of x name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))  # a shift counts modulo 64


def may_hold(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A filter of fixed size: a condition on a column of longs that is true for every value of keys and for few others.

    It keeps rows from moving through a join; the join decides.
    """
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(FILTER_BITS))
    words = keys.select(spot(F.col(key)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(one_bit(F.col("s"))).alias("m"))
    every = keys.sparkSession.range(FILTER_BITS // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    bitmap = every.agg(F.sort_array(F.collect_list(F.struct("id", "m"))).alias("a")).select(F.transform("a", lambda x: x["m"])).scalar()
    return lambda c: F.element_at(bitmap, (F.shiftright(spot(c), 6) + 1).cast("int")).bitwiseAND(one_bit(spot(c))) != 0


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each have about `limit` bytes (one longer text stays whole)."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts.  offsets has one entry more than rows."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])), at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed random values of bytes and the odd base of the rolling hash (mod 2^64).
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE_BYTES + 65536), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) of every value."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)) if seed else x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; other bytes stay."""
    low = _LOWER[data]
    if len(low) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][up] += 32
    return low


class Words:
    """Words of a batch: start, end (byte places), doc (row) and first (the first word of each row, one entry more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: bool = False):
        inside = _LETTER[data] if letters else ~_SPACE[data]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[edge] = inside[edge]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running hash H with H[j] - H[i] = the sum of the bytes i..j-1 by their powers."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, down = _powers(len(running))
    return mix((running[end] - running[start]) * down[start])


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words on end and the first shingle of each row; a row of 1 to k-1 words has one shingle of all of them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    last = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        ok = at + j < last
        h = words[np.minimum(at + j, len(words) - 1)] if len(words) else np.zeros(0, np.uint64)
        out = np.where(ok, out * np.uint64(0x100000001B3) + h, out)
    return mix(out, 1), begin


#: Places in a text where a word-by-word tokenizer may be cut: one blank between two characters that are no white space.
UNSAFE_BLANK = re.compile(r" \s|\s ")


def safe_words(text: str) -> list[str] | None:
    """The text cut at every single blank, if each is a safe boundary; else None."""
    if not text or text[0] == " " or text[-1] == " " or UNSAFE_BLANK.search(text):
        return None
    return text.split(" ")


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
