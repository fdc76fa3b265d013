"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to k = floor(rate * m) edits.  It is cut into chunks of at most 64
characters: one chunk then has at most its share of the budget, and of that chunk's pieces (one more than the share) one
stands in the text as it is.  Exact hits of pieces are found by an automaton; Myers' bit-parallel distance checks the chunk
around each hit, in 64-bit words for all hits at once, and then the whole item around what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from exalake.llm.text_arrays import byte_slices

ERROR_RATE = 0.1
#: Items of fewer words are too short to tell a leak from chance; they are not searched.
LEAST_WORDS = 5
#: Characters of test items in one block; more items are more blocks, each run against all documents.
BLOCK_CHARS = 4_000_000
CHUNK = 64
HITS_AT_ONCE = 1 << 15


def normal(text: str) -> str:
    """Lower case, white space as single blanks."""
    return " ".join(text.lower().split())


@dataclass
class Chunk:
    item: int
    offset: int
    length: int
    budget: int


class ItemBlock:
    """Items of one block, with the automaton of their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE, least_words: int = LEAST_WORDS):
        self.ids, self.texts = [], []
        for i, t in items:
            t = normal(t or "")
            if len(t.split()) >= least_words:
                self.ids.append(i), self.texts.append(t)
        self.budget = [int(rate * len(t) + 1e-9) for t in self.texts]
        self.chunks: list[Chunk] = []
        self.pieces: dict[str, list[tuple[int, int]]] = {}  # piece -> (chunk, place in the chunk)
        for i, t in enumerate(self.texts):
            n = -(-len(t) // CHUNK)
            edges = [round(j * len(t) / n) for j in range(n + 1)]
            share = self.budget[i] // n
            for a, b in zip(edges, edges[1:], strict=False):
                self.chunks.append(Chunk(i, a, b - a, share))
                cuts = [a + round(j * (b - a) / (share + 1)) for j in range(share + 2)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    self.pieces.setdefault(t[x:y], []).append((len(self.chunks) - 1, x - a))
        self.ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("ids", "texts", "budget", "chunks", "pieces")} | {"ready": False}

    def prepare(self) -> None:
        """What isn't shipped: automaton, letter numbers and match masks."""
        if self.ready:
            return
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for n, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, (n, len(piece)))
        if self.pieces:
            self.automaton.make_automaton()
        places = list(self.pieces.values())
        self.piece_first = np.append(0, np.cumsum([len(p) for p in places])).astype(np.int64)
        flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 2)
        self.of_chunk, self.of_place = flat[:, 0], flat[:, 1]
        letters = sorted({c for t in self.texts for c in t})
        self.letter = {ord(c): k + 1 for k, c in enumerate(letters)}
        self.low = np.zeros(0x10000, np.int32)
        for c, k in self.letter.items():
            if c < 0x10000:
                self.low[c] = k
        self.mask = np.zeros((len(self.chunks), len(letters) + 1), np.uint64)
        for n, c in enumerate(self.chunks):
            for j, ch in enumerate(self.texts[c.item][c.offset : c.offset + c.length]):
                self.mask[n, self.letter[ord(ch)]] |= np.uint64(1 << j)
        self.mask_flat = self.mask.ravel()
        field = lambda f: np.array([getattr(c, f) for c in self.chunks], np.int64)
        self.chunk_item, self.chunk_offset, self.chunk_length, self.chunk_budget = (field(f) for f in ("item", "offset", "length", "budget"))
        self.whole: dict[int, dict[str, int]] = {}
        self.ready = True

    def letters_of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.low[np.minimum(codes, 0xFFFF)]
        if len(codes) and codes.max() > 0xFFFE:
            high = np.flatnonzero(codes > 0xFFFE)
            out[high] = [self.letter.get(int(c), 0) for c in codes[high]]
        return out

    def chunk_holds(self, text: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Whether each chunk matches within its budget about its expected start (at), in places low to high of text."""
        m, e = self.chunk_length[chunk], self.chunk_budget[chunk]
        shift = (m - 1).astype(np.uint64)
        one = np.uint64(1)
        pv, mv = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        score, best = m.copy(), m.copy()
        row = chunk * self.mask.shape[1]
        begin, end = np.maximum(at - e, low), np.minimum(at + m + e, high)
        for j in range(int((end - begin).max(initial=0))):
            place = begin + j
            live = place < end
            eq = self.mask_flat[row + np.where(live, text[np.minimum(place, len(text) - 1)], 0)]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> shift) & one).view(np.int64)
            score -= ((mh >> shift) & one).view(np.int64)
            ph <<= one
            mh <<= one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, np.where(live, score, best), out=best)
        return best <= e

    def distance(self, item: int, window: str) -> int:
        """The least edits that make the item a part of the window (Myers, one long word)."""
        p = self.texts[item]
        eqs = self.whole.get(item)
        if eqs is None:
            eqs = self.whole[item] = {}
            for j, c in enumerate(p):
                eqs[c] = eqs.get(c, 0) | 1 << j
        m = len(p)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = full, 0, m, m
        for c in window:
            eq = eqs.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += bool(ph & top) - bool(mh & top)
            best = score if score < best else best
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
        return best

    def search(self, texts: list[str | None]) -> list[list[tuple[object, int]]]:
        """(item id, least distance among the places that were tried) of the items that each text holds."""
        self.prepare()
        out: list[list[tuple[object, int]]] = [[] for _ in texts]
        if not self.pieces:
            return out
        normed, ends, owner = [], [], []
        for n, raw in enumerate(texts):
            text = normal(raw) if raw else ""
            normed.append(text)
            hits = [(end, k, size) for end, (k, size) in self.automaton.iter(text)]
            ends += hits
            owner += [n] * len(hits)
        if not ends:
            return out
        got, doc = np.array(ends, np.int64), np.array(owner, np.int64)
        count = self.piece_first[got[:, 1] + 1] - self.piece_first[got[:, 1]]
        which = np.repeat(self.piece_first[got[:, 1]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(got[:, 0] - got[:, 2] + 1, count) - self.of_place[which]
        tries = np.unique(np.stack([np.repeat(doc, count), self.of_chunk[which], start], 1), axis=0)
        codes = self.letters_of("".join(normed))
        base = np.append(0, np.cumsum([len(t) for t in normed]))
        found: list[dict[int, int]] = [{} for _ in texts]
        for s in range(0, len(tries), HITS_AT_ONCE):
            doc, chunk, start = tries[s : s + HITS_AT_ONCE].T
            keep = self.chunk_holds(codes, start + base[doc], base[doc], base[doc + 1], chunk)
            doc, chunk, start = doc[keep], chunk[keep], start[keep]
            item = self.chunk_item[chunk]
            for n, i, b in dict.fromkeys(zip(doc.tolist(), item.tolist(), (start - self.chunk_offset[chunk]).tolist(), strict=True)):
                k = self.budget[i]
                if found[n].get(i, k + 1) == 0:
                    continue
                if (d := self.distance(i, normed[n][max(0, b - k) : b + len(self.texts[i]) + k])) <= k:
                    found[n][i] = min(d, found[n].get(i, d))
        return [[(self.ids[i], d) for i, d in sorted(f.items())] for f in found]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> Iterator[ItemBlock]:
    """The test items in blocks of bounded size, brought to the driver one block at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield ItemBlock(sorted(((r.id, r.text) for r in block.collect()), key=repr), rate)


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(id, item id, distance) of every document that holds a test item within floor(rate * length) edits.

    Texts and items are compared in lower case with white space as single blanks.  Null and empty texts hold nothing; items
    of fewer than LEAST_WORDS words and null items aren't searched; an empty table on either side gives no rows.  A row of
    docs that is repeated gives its rows again.
    """
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = source.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    out = None
    for block in item_blocks(items, item_col, item_text_col, rate):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for part in byte_slices(batches, "text"):
                found = block.search(part.column("text").to_pylist())
                at = pa.array([n for n, f in enumerate(found) for _ in f], pa.int64())
                ids = pa.array([i for f in found for i, _ in f])
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), ids.cast(item_type) if len(ids) else pa.nulls(0, item_type), pa.array([d for f in found for _, d in f], pa.int64())], ["id", "item", "distance"])

        one = source.mapInArrow(search, f"id {kind}, item {item_kind}, distance long")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else "item"), "distance")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs, all columns, that hold no test item (see contaminations); null texts stay."""
    for block in item_blocks(items, item_col, item_text_col, rate):
        docs = docs.where(holds_none(block)(F.col(text_col)))
    return docs


def holds_none(block: ItemBlock):
    """An Arrow function of texts: whether they hold no item of block."""

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array([not f for part in byte_slices(iter([batch]), "text") for f in block.search(part.column("text").to_pylist())], pa.bool_())

    return clean
