"""Quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from what its words and signs look like; a gated attention layer,
learned from document labels alone, weighs the passages; the weighted representation is scored.  One page of junk in a
long document thus counts, though no passage has a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.labelled import SAMPLE_ROWS, scored, training_rows
from exalake.llm.text_arrays import Words, byte_slices, lower_bytes, prefix_hashes, span_hashes, utf8

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
PASSAGE_WORDS = 48
HIDDEN, GATE = 16, 8
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 stop and comma, 5 other sign, 6 not ASCII, 7 line end, 8 bar
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:'-"]] = 4
_CLASS[[ord(c) for c in "!\"#$%&()*+/<=>?@[\\]^_`{}~"]] = 5
_CLASS[10], _CLASS[ord("|")] = 7, 8
FEATURES = 17


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): FEATURES numbers a passage of PASSAGE_WORDS words, and the first passage of each row (one more)."""
    low = lower_bytes(data)
    words = Words(low, offsets)
    per = np.diff(words.first)
    count = np.maximum(1, -(-per // PASSAGE_WORDS))
    first = np.append(0, np.cumsum(count))
    if not len(first) - 1:
        return np.zeros((0, FEATURES), np.float32), first
    n = int(first[-1])
    place = np.arange(len(words.doc)) - words.first[words.doc]
    of = first[words.doc] + place // PASSAGE_WORDS
    size = np.bincount(of, minlength=n).astype(float)
    full = np.maximum(size, 1)
    length = words.end - words.start
    out = [np.log1p(size), np.bincount(of, length, n) / full, np.bincount(of, length > 12, n) / full, np.bincount(of, length <= 1, n) / full]
    starts = np.append(words.start, len(data))
    begin = np.searchsorted(of, np.arange(n))
    total = np.maximum(np.bincount(of, length, n), 1)
    kind = _CLASS[data]
    for c in (1, 3, 4, 5, 6, 7, 8):
        running = np.append(0, np.cumsum(kind == c))
        a, b = starts[begin], starts[np.append(begin[1:], len(words.doc))]
        b = np.where(size > 0, b, a)
        out.append((running[b] - running[a]) / total)
    h = span_hashes(prefix_hashes(low), words.start, words.end)
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    out.append(np.bincount((key >> np.uint64(40)).astype(np.int64), new, n) / full)
    same = np.append(False, h[1:] == h[:-1])[: len(h)] & (place > 0)
    out.append(np.bincount(of, same, n) / full)
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    out.append(np.bincount(of, np.isin(last, [33, 35, 36, 37, 38, 42]), n) / full)
    head = kind[words.start] == 1 if len(words.start) else np.zeros(0, bool)
    out.append(np.bincount(of, head, n) / full)
    out.append(np.bincount(of, kind[words.end - 1] == 1 if len(words.end) else head, n) / full)
    out.append(np.repeat(np.log1p(count), count) / 5)
    return np.stack(out, 1).astype(np.float32), first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    par: list[np.ndarray]  # encoder, its bias, tanh gate, sigmoid gate, attention, scorer, its bias

    def forward(self, x: np.ndarray, first: np.ndarray):
        w1, b1, v, u, a, c, b = self.par
        h = np.tanh(x @ w1 + b1)
        tv, su = np.tanh(h @ v), _sigmoid(h @ u)
        e = (tv * su) @ a
        starts, size = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        att = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(att[:, None] * h, starts)
        return h, tv, su, att, z, _sigmoid(z @ c + b[0])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, first)[-1] if len(first) > 1 else np.zeros(0)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
    """Attention, encoder and scorer learned together from the labels of whole documents."""
    rng = np.random.default_rng(6)
    par = [rng.normal(0, 0.3, s) for s in ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,))] + [np.zeros(1)]
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        par = [np.zeros_like(p) for p in par[:-1]] + [np.array([np.log(share / (1 - share))])]
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), par)
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3, par)
    x = (x - model.mean) / model.scale
    starts, size, n = first[:-1], np.diff(first), len(label)
    m, s = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for step in range(1, steps + 1):
        w1, b1, v, u, a, c, b = model.par
        h, tv, su, att, z, p = model.forward(x, first)
        err = (p - label) / n
        dz = np.repeat(err, size)[:, None] * c
        d_att = (dz * h).sum(1)
        de = att * (d_att - np.repeat(np.add.reduceat(att * d_att, starts), size))
        dg = de[:, None] * a
        d_tv, d_su = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh = (att[:, None] * dz + d_tv @ v.T + d_su @ u.T) * (1 - h**2)
        grads = [x.T @ dh, dh.sum(0), h.T @ d_tv, h.T @ d_su, ((tv * su) * de[:, None]).sum(0), z.T @ err, np.array([err.sum()])]
        for i, g in enumerate(grads):
            g = g + decay * model.par[i]
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g**2
            model.par[i] = model.par[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> AttentionModel:
    """Fit on at most `rows` labelled documents outside the held-out fold; their passages are encoded on the executors."""
    sample = training_rows(docs, labels, label, id_col, text_col, FOLDS, HELD, rows)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            x, first = passages(*utf8(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(first * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "x"])

    got = sample.mapInArrow(bags, "label int, x array<float>").toArrow()
    bag = [np.asarray(v.values, np.float32).reshape(-1, FEATURES) for v in got.column("x")]
    order = sorted(range(len(bag)), key=lambda i: (len(bag[i]), bag[i].tobytes()))  # rows come in any order
    label_of = np.array(got.column("label").to_pylist(), dtype=np.float64)
    if not order:
        return fit(np.zeros((0, FEATURES)), np.zeros(1, np.int64), label_of)
    return fit(np.concatenate([bag[i] for i in order]).astype(np.float64), np.append(0, np.cumsum([len(bag[i]) for i in order])), label_of[order])


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs; a null or empty text is one passage without words."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(*passages(*utf8(part.column("text")))))], ["id", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from THRESHOLD on).

    Null and empty texts are scored as one passage without words.  Without labels of both kinds every score is the share of
    label 1 (smoothed).  Repeated rows give a row each; other columns, and label columns of docs, aren't used.
    """
    return scored(score(docs, train(docs, labels, id_col, text_col), id_col, text_col), id_col, FOLDS, HELD, THRESHOLD)
