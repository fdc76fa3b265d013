"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words in lower case without signs, and the first letters of long words.  The machine
gives each term a weight and a vector; products of vectors score pairs of terms, such as an insult beside a group, that
weights alone can't.  Terms that tell nothing in the sample have no weight, so long documents gather no noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.labelled import SAMPLE_ROWS, scored, training_rows
from exalake.llm.text_arrays import Words, byte_slices, lower_bytes, mix, prefix_hashes, span_hashes, utf8

FOLDS, HELD, THRESHOLD = 3, 1, 0.7
RANK = 6
#: Bytes of the first letters that long words are also known by.
STEM_BYTES = 6
#: A term counts if it stands in so many sample documents and its likelihood ratio against the label is so large.
LEAST_DOCS, LEAST_G = 4, 20.0
MOST_TERMS = 2048


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term hash) of every word and stem of a batch."""
    low = lower_bytes(data)
    words = Words(low, offsets, letters=True)
    running = prefix_hashes(low)
    long = words.end - words.start > STEM_BYTES
    stem = mix(span_hashes(running, words.start[long], words.start[long] + STEM_BYTES), 11)
    return np.concatenate([words.doc, words.doc[long]]), np.concatenate([span_hashes(running, words.start, words.end), stem])


@dataclass
class FactorizationMachine:
    term: np.ndarray  # sorted hashes
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.term)
        linear, total, squares = np.full(n, self.bias), np.zeros((n, RANK)), np.zeros((n, RANK))
        if k:
            doc, h = terms(data, offsets)
            door = np.zeros(1 << 16, bool)
            door[self.term & np.uint64(0xFFFF)] = True
            maybe = np.flatnonzero(door[h & np.uint64(0xFFFF)])
            at = np.minimum(np.searchsorted(self.term, h[maybe]), k - 1)
            hit = self.term[at] == h[maybe]
            pair = np.unique(doc[maybe[hit]] * k + at[hit])
            doc, at = pair // k, pair % k
            linear += np.bincount(doc, self.weight[at], n)
            for f in range(RANK):
                v = self.vector[at, f]
                total[:, f] = np.bincount(doc, v, n)
                squares[:, f] = np.bincount(doc, v * v, n)
        z = linear + 0.5 * (total**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: list[np.ndarray], label: np.ndarray, steps: int = 250, rate: float = 0.05, decay: float = 1e-3) -> FactorizationMachine:
    """The machine from term sets of labelled documents; the same at every call with the same rows."""
    pos, n = max(label.sum(), 1), max(len(label), 1)
    if not docs or label.min(initial=1) == label.max(initial=0):
        share = (label.sum() + 1) / (len(label) + 2)
        return FactorizationMachine(np.zeros(0, np.uint64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, RANK)))
    size = np.array([len(d) for d in docs])
    flat, row = np.concatenate(docs), np.repeat(np.arange(n), size)
    known, inverse = np.unique(flat, return_inverse=True)
    both, ones = np.bincount(inverse, minlength=len(known)), np.bincount(inverse, label[row], len(known))
    p = pos / n
    ratio = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    g = 2 * (ratio(ones, both * p) + ratio(both - ones, both * (1 - p)))
    good = np.flatnonzero((both >= LEAST_DOCS) & (g >= LEAST_G))
    good = np.sort(good[np.argsort(-g[good], kind="stable")[:MOST_TERMS]])
    place = np.full(len(known), -1)
    place[good] = np.arange(len(good))
    keep = place[inverse] >= 0
    x = np.zeros((n, len(good)), np.float32)
    x[row[keep], place[inverse[keep]]] = 1
    rng = np.random.default_rng(5)
    par = [np.array(np.log(p / (1 - p)), np.float32), np.zeros(len(good), np.float32), rng.normal(0, 0.05, (len(good), RANK)).astype(np.float32)]
    m, v = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
    for step in range(1, steps + 1):
        b, w, vec = par
        xv = x @ vec
        z = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (vec**2).sum(1))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label).astype(np.float32) / n
        xe = x.T @ err
        grads = [err.sum(), xe + decay / 10 * w, x.T @ (err[:, None] * xv) - xe[:, None] * vec + decay / 10 * vec]
        for i, gr in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr**2
            par[i] = (par[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return FactorizationMachine(known[good], float(par[0]), par[1].astype(float), par[2].astype(float))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on at most `rows` labelled documents outside the held-out fold; their term sets are made on the executors."""
    sample = training_rows(docs, labels, label, id_col, text_col, FOLDS, HELD, rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            doc, h = terms(*utf8(part.column("text")))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)]
            ends = np.searchsorted(doc[new], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "terms"])

    got = sample.mapInArrow(sets, "label int, terms array<long>").toArrow()
    flat = [np.asarray(t.values, dtype=np.int64).view(np.uint64) for t in got.column("terms")]
    order = sorted(range(len(flat)), key=lambda i: (len(flat[i]), flat[i].tobytes()))  # rows come in any order
    label_of = np.array(got.column("label").to_pylist(), dtype=np.float64)
    return fit([flat[i] for i in order], label_of[order] if len(order) else label_of)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs; a null or empty text has the score of no terms."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(*utf8(part.column("text"))))], ["id", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts get the score of a document without terms.  Without labels of both kinds every score is the share
    of label 1 (smoothed).  Repeated rows give a row each; other columns, and label columns of docs, aren't used.
    """
    return scored(score(docs, train(docs, labels, id_col, text_col), id_col, text_col), id_col, FOLDS, HELD, THRESHOLD)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that the machine (fitted on training_docs, or docs) does not predict as toxic."""
    model = train(docs if training_docs is None else training_docs, labels, id_col, text_col)

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:  # an Arrow column in and out, so that rows keep all their columns
        out = [model.score(*utf8(part.column("text"))) for part in byte_slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text")]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.where(toxic(F.col(text_col)) < THRESHOLD)
