"""SentencePiece BPE in vectorised merge rounds, and decoding.

A batch of words lies in flat numpy arrays of symbols.  In each round every word finds the best-ranked pair it has (a
segmented minimum); in all words at once the leftmost pairs of that rank merge, without overlap; then the arrays are
compacted, until no pair is left.  A rank whose merge can create a better-ranked pair merges one place per word and round
only, so the order is that of the library's queue.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.text_arrays import byte_slices, safe_words

BLANK = "▁"
#: Distinct words that a worker keeps encoded; beyond it the store is emptied (results don't depend on it).
KEPT_WORDS = 250_000
LONG_WORD = 200
#: Characters that one run of merge rounds takes; a longer word is a run of its own.
ROUND_CHARS = 1 << 17
NONE = np.int64(2**62)
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class PieceModel:
    """Merge table of a BPE model file: pieces, the merged piece and rank of each pair, and which ranks merge one by one."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_value = {i: b for b, i in self.byte_id.items()}
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        of = {self.pieces[i]: i for i in plain}
        score = {i: sp.get_score(i) for i in plain}
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
        if any(BLANK in p.lstrip(BLANK) for p in of):
            raise ValueError("a piece has a blank after another character: words can't be encoded apart")
        self.size = n
        left, right, out = [], [], []
        one_by_one = np.zeros(len(plain), bool)
        for p, i in of.items():
            for k in range(1, len(p)):
                a, b = of.get(p[:k]), of.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(i)
                    for x in (a, b):
                        if rank[i] <= rank[x]:
                            one_by_one[rank[x]] = True
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        self._table(key, np.array(out, np.int64), np.array([rank[i] for i in out], np.int64))
        self.one_by_one = one_by_one
        self.char_id = {p: i for p, i in of.items() if len(p) == 1}
        self.plain = [" \u2047 " if i == self.unk else "" if i in self.silent else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]

    def _table(self, key: np.ndarray, out: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing: a pair's slot is its hash, or one of the next few."""
        self.bits = max(4, int(np.ceil(np.log2(len(key) * 6 + 1))))
        slots = 1 << self.bits
        self.slot_key = np.full(slots, -1, np.int64)
        self.slot_out, self.slot_rank = np.zeros(slots, np.int64), np.full(slots, NONE)
        left, at, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(left):
            free = self.slot_key[at] == -1
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), bool)
            won[one] = True
            won &= free
            self.slot_key[at[won]], self.slot_out[at[won]], self.slot_rank[at[won]] = key[left[won]], out[left[won]], rank[left[won]]
            left, at = left[~won], (at[~won] + 1) & (slots - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of neighbours; NONE where they don't merge."""
        key = np.where((a < self.size) & (b < self.size), a * self.size + b, -2)
        at = self._slot(key)
        found = self.slot_key[at]
        missed = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(missed):
                break
            at[missed] = (at[missed] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[missed]]
            missed = missed[(found != key[missed]) & (found != -1)]
        hit = self.slot_key[at] == key
        return np.where(hit, self.slot_rank[at], NONE), self.slot_out[at]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols; word: the (ascending) word number of each symbol."""
        if len(sym) < 2:
            return sym, word
        done_sym, done_word = [], []
        rank, out = self.pairs(sym[:-1], sym[1:])
        rank, out = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE), np.append(out, 0)
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            open_word = best < NONE
            if not open_word.all():  # finished words leave the arrays
                keep = np.repeat(open_word, size)
                done_sym.append(sym[~keep]), done_word.append(word[~keep])
                sym, word, rank, out = sym[keep], word[keep], rank[keep], out[keep]
                best, size = best[open_word], size[open_word]
                if not len(sym):
                    break
            level = np.repeat(best, size)
            at = np.flatnonzero(rank == level)
            # leftmost without overlap: in a run of places on end every second one; or the first of the word
            place = np.arange(len(at))
            run_start = np.append(True, at[1:] != at[:-1] + 1)
            place -= np.maximum.accumulate(np.where(run_start, place, 0))
            first = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[np.where(self.one_by_one[level[at]], first, place % 2 == 0)]
            sym[at] = out[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank, out = sym[stay], word[stay], rank[stay], out[stay]
            at -= np.arange(len(at))  # where the merged symbols are now
            touched = np.concatenate([at, at[at > 0] - 1])
            last = touched == len(sym) - 1
            nxt = np.minimum(touched + 1, len(sym) - 1)
            r, o = self.pairs(sym[touched], sym[nxt])
            rank[touched] = np.where(last | (word[touched] != word[nxt]), NONE, r)
            out[touched] = o
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (blanks already written as the blank mark)."""
        out: list[list[int]] = []
        group: list[str] = []
        size = 0
        for w in words:
            group.append(w)
            size += len(w)
            if size >= ROUND_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group) if group else out

    def _encode(self, words: list[str]) -> list[list[int]]:
        joined = "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(codes, return_inverse=True)
        # unknown characters get numbers from size on: they never merge
        ids = np.array([self.char_id.get(chr(c), self.size + c) for c in distinct], np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym, word = self.merge(ids[inverse] if len(codes) else np.zeros(0, np.int64), word)
        flat, odd = sym.tolist(), set(word[sym >= self.size].tolist())
        ends = np.searchsorted(word, np.arange(1, len(words) + 1)).tolist()
        out, begin = [], 0
        for w, end in enumerate(ends):
            out.append(self._bytes(flat[begin:end]) if w in odd else flat[begin:end])
            begin = end
        return out

    def _bytes(self, flat: list[int]) -> list[int]:
        out: list[int] = []
        for i in flat:
            if i < self.size:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(i - self.size).encode()]
            else:
                out.append(self.unk)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8, blank marks as blanks, the first blank dropped; control ids are silent."""
        plain, byte = self.plain, self.byte_value
        if byte.keys().isdisjoint(ids):
            text = "".join([plain[i] for i in ids])
        else:
            text = b"".join([bytes([byte[i]]) if i in byte else plain[i].encode() for i in ids]).decode("utf-8", errors="replace")
        first = next((i for i in ids if i not in self.silent), self.unk)
        return text[1:] if first != self.unk and self.pieces[first][:1] == BLANK else text


class Codec:
    """Encodes and decodes texts, word by word; keeps the words it has seen."""

    def __init__(self, model_file: str):
        self.model = PieceModel(model_file)
        self.known: dict[str, tuple[int, str, str]] = {}

    def words(self, text: str) -> list[str]:
        """The text in words, each standing for a blank mark and itself; one that holds marks stands for itself alone."""
        words = safe_words(text)
        if words is None or BLANK in text or "\0" in text:
            units = _UNITS.findall(BLANK + text.replace(" ", BLANK)) if text else []
            return [u[1:] if u[:1] == BLANK and BLANK not in u[1:] and u[1:2] not in ("", "\0") else "\0" + u for u in units]
        return words

    def learn(self, words: set[str]) -> dict[str, tuple[int, str, str]]:
        """Of each word: number of ids, the ids joined, the decoded word without the blank before it."""
        new = list(words)
        units = [w[1:] if w[:1] == "\0" else BLANK + w for w in new]
        out = {}
        for w, ids in zip(new, self.model.encode_words(units), strict=True):
            back = self.model.decode(ids)
            out[w] = (len(ids), " ".join(map(str, ids)), w if back == w else back)
        return out

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, the ids joined by blanks, the decoded text), with the end id last."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, cut, new, big = self.known, [], set(), set()
        for t in texts:
            words = self.words(t) if t else []
            cut.append(words)
            new.update(words)
        new -= known.keys()
        if len(new) > 0:
            big = {w for w in new if len(w) > LONG_WORD}
            known.update(self.learn(new - big))
            known.update(self.learn(big))
        end = str(self.model.eos)
        out = []
        for words in cut:
            if not words:
                out.append((1, end, ""))
                continue
            n, ids, back = zip(*[known[w] for w in words], strict=True)
            out.append((sum(n) + 1, f"{' '.join(ids)} {end}", " ".join(back)))
        for w in big:
            del known[w]
        return out


def _checked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (array of int, the end id last), lossless, decoded (unless with_text is False).

    lossless: decoding gives the text back.  A null text is encoded as an empty one: the end id alone, decoded as ''.
    Repeated rows and null ids give a row each; other columns are ignored.  model_file must exist on every executor.
    """
    source = _checked(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        for part in byte_slices(batches, "text"):
            texts = part.column("text").to_pylist()
            got = codec.run(texts)
            n = np.array([g[0] for g in got], np.int64)
            flat = np.fromstring(" ".join([g[1] for g in got]), np.int32, sep=" ")
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat))
            same = pa.array([g[2] == (t or "") for g, t in zip(got, texts, strict=True)], pa.bool_())
            columns, names = [part.column("id"), pa.array(n), ids, same], ["id", "n_tokens", "ids", "lossless"]
            if with_text:
                columns, names = [*columns, pa.array([g[2] for g in got], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens long, ids array<int>, lossless boolean" + ", decoded string" * with_text
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but digests only: id, n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256."""
    source = _checked(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in byte_slices(batches, "text"):
            got = codec.run(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got]), pa.array([sha(g[2]) for g in got])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
