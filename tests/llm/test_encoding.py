"""Token counts and SentencePiece against the libraries themselves."""

import random

import public_tokenizers
import pytest

from exalake.llm import sentencepiece_bpe, token_counts

ATOMS = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "😀", "<|endoftext|>", "</s>", "<0x0A>", "\t", "1", "42", ".", "…", "\xa0", "'s", "tt", "th", "xxx", "ß", "中", "\0", "　"]
ODD = ["", " ", "  ", "▁", " ▁", "a ", None, "ab" * 3000, " " * 300, "aaaa" * 1000, "the" * 800, "\0a \0", "x" * 500 + " y"]


def texts(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ODD


def test_lengths_equal_the_library():
    counter = token_counts.TokenLengths(public_tokenizers.path("byte_bpe_50k.json"))
    given = texts()
    want = [len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in given]
    assert counter.counts(given) == want


def test_small_store_gives_the_same(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 5)
    counter = token_counts.TokenLengths(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts(50):
        assert counter.counts([t]) == [len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)]


def test_pieces_join_to_the_text():
    for t in texts(300):
        assert "".join(token_counts.safe_pieces(t or "")) == (t or "")


def test_ids_and_text_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Codec(path)
    given = texts()
    for t, (n, ids, back) in zip(given, codec.run(given), strict=True):
        want = sp.encode(t or "", add_eos=True)
        assert (n, ids, back) == (len(want), " ".join(map(str, want)), sp.decode(want))


def test_merge_order_with_unsafe_ranks():
    """Every rank that can make a better pair merges one place at a time; all ranks one by one must give the same."""
    model = sentencepiece_bpe.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁" + "".join(random.Random(i).choice("abcdeinorstu") for _ in range(30)) for i in range(200)]
    fast = model.encode_words(words)
    model.one_by_one[:] = True
    assert model.encode_words(words) == fast


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "one two", 5), (None, None, 6), (2, "", 7), (2, "", 7), (3, "x" * 3000 + " " + "y z " * 500, 8)], "doc_id long, text string, n_tokens long")


def test_frames(spark, docs):
    out = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    assert [g[:2] for g in got] == [(0, 0), (1, 7), (2, 0), (2, 0), (3, 5001)] and [g[3] for g in got] == [False, False, False, False, True]
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece_bpe.encode_decode(docs, path).collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in rows) and len(rows) == 5
    assert sentencepiece_bpe.round_trip_digests(docs.limit(0), path).count() == 0
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
