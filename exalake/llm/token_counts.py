"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are cut at safe boundaries: one blank between two characters that are not white space is always the edge of a
pre-token of byte-level BPE, so the counts of the pieces add up to the count of the whole.  Pieces that repeat are encoded
once a worker; what is left is encoded in batches of about equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.text_arrays import byte_slices, single_threaded

#: Distinct pieces whose lengths a worker keeps; beyond it the store is emptied (results don't depend on it).
KEPT_PIECES = 600_000
#: Bytes of text in one call of the encoder.
BATCH_BYTES = 1 << 20
#: Pieces of more characters aren't kept.
LONG_PIECE = 200
WHITE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　")


def safe_pieces(text: str) -> list[str]:
    """Cut before each single blank between two characters that are no white space; joined, they are the text."""
    out: list[str] = []
    for i, word in enumerate(text.split(" ")):
        piece = " " + word if i else word
        if i and (not word or word[0] in WHITE or not out[-1] or out[-1][-1] in WHITE):
            out[-1] += piece
        else:
            out.append(piece)
    return out


class TokenLengths:
    """Token counts of texts by one tokenizer file; keeps what it has seen."""

    def __init__(self, tokenizer_file: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.known: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        """Lengths by the library, in calls of about BATCH_BYTES."""
        out: list[int] = []
        start = size = 0
        for i, p in enumerate(pieces):
            size += 4 * len(p)
            if size >= BATCH_BYTES or i == len(pieces) - 1:
                out += [len(e) for e in self.tokenizer.encode_batch_fast(pieces[start : i + 1], add_special_tokens=False)]
                start, size = i + 1, 0
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        cut = [safe_pieces(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in known and len(p) <= LONG_PIECE})
        known.update(zip(new, self.encode(new), strict=True))
        big = list({p for pieces in cut for p in pieces if len(p) > LONG_PIECE})
        long = dict(zip(big, self.encode(big), strict=True)) if big else {}
        return [sum([known[p] if len(p) <= LONG_PIECE else long[p] for p in pieces]) if long else sum([known[p] for p in pieces]) for pieces in cut]


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null ids give a row each.  Other columns of docs are
    ignored.  tokenizer_file must exist on every executor.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = TokenLengths(tokenizer_file)
        for part in byte_slices(batches, "text"):
            n = pa.array(lengths.counts(part.column("text").to_pylist()), pa.int64())
            size = pc.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), size, n], ["id", "n_bytes", "n_tokens"])

    counted = source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
