"""Pivot partitioning against plain counts of all n-grams."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from exalake.llm import phrases


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain_counts(rows, most):
    f = collections.Counter()
    for lang, text in rows:
        for words in plain_words(text):
            for m in range(1, most + 1):
                f.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    return f


def plain(rows, min_count, most, top):
    f = plain_counts(rows, most)
    n = collections.Counter()
    for k, v in f.items():
        if len(k) == 2:
            n[k[0]] += v
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if not any(lang == o and len(v) > len(w) and inside(v) and 100 * b >= 50 * a for (o, *v), b in found.items()):
            out[lang].append((-score, -a, " ".join(w), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p, -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs, key=lambda x: (*x[:2], x[2].encode()))[:top]))


def made_up(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "A", "the", "The", "é", "É", "long-" * 30, "x y", "7"] + [f"w{i}" for i in range(12)]
    gap = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "?!", " \x0b"]
    weight = [40] + [1] * 8
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words[: rng.choice([3, 22])]) + rng.choices(gap, weight)[0] for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("most", "words", "group"), [(3, 1 << 17, 20_000), (3, 4, 3), (4, 0, 20_000), (2, 9, 1)])
def test_phrases_equal_plain_ones(spark, most, words, group):
    rows = made_up(160, most + group)
    rows += [("en", "hot pair hot pair hot pair. " * 40)] * 30 + [("en", None), (None, ""), ("fr", "only once")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(5)
    got = sorted(map(tuple, phrases.phrases(frame, most=most, top=40, group=group, ranked=words).collect()))
    assert got == plain(rows, 10, most, 40) and len(got) > 20
    assert phrases.phrases(frame.where("lang = 'xx'")).collect() == []


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 100)
    text = "Some words, and more. " * 40 + "one piece without an end " * 20
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    slices = list(phrases._slices(iter([batch])))
    assert len(slices) > 5 and b"".join(x.tobytes() for x, *_ in slices).decode() == text.lower()
    counts = collections.Counter()
    for b in phrases._count_words(iter([batch])):
        counts.update({(r["lang"], r["word"]): r["n"] for r in b.to_pylist()})
    want = plain_counts([("en", text)], 1)
    assert counts == want


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 3 * 10**11), ("en", "a b c", 10**11 + 7)], "lang string, phrase string, a long")
    counts = spark.createDataFrame([("en", w, f) for w, f in (("a", 10**12 + 1), ("b", 10**12 + 3), ("c", 10**11 + 9))], "lang string, word string, f long")
    # b c, a cut of a b c, is a candidate too wherever a b c is
    found = found.union(spark.createDataFrame([("en", "b c", 10**11 + 8)], found.schema))
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored(found, counts).collect()}
    a, c = 10**11 + 7, 10**11 + 9
    cuts = [(10**6 * a * a // (x * y), x, y) for x, y in ((10**12 + 1, 10**11 + 8), (3 * 10**11, c))]
    assert got["a b c"] == (min(cuts)[1], min(cuts)[2], min(cuts)[0])
    assert got["a b"] == (10**12 + 1, 10**12 + 3, 10**6 * 9 * 10**22 // ((10**12 + 1) * (10**12 + 3)))


def test_one_owner_for_each_ngram():
    """Whatever the ranks, each occurrence is in one fragment around its pivot's place."""
    words = "a b a b a a c b a".split()
    for ranked in ([("en", "a", 30), ("en", "b", 20), ("en", "c", 9)], [("en", "b", 30)], []):
        batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words)]})
        seen = collections.Counter()
        for b in phrases._rewrite(phrases.Ranks(ranked, False), 3, 100)(iter([batch])):
            for r in b.to_pylist():
                w, at = r["fragment"].split(" "), r["place"]
                assert len(w) <= 5
                spots = [tuple(w[i : i + m]) for m in (2, 3) for i in range(len(w) - m + 1) if i <= at < i + m]
                seen.update(spots * r["n"])
        want = collections.Counter(tuple(words[i : i + m]) for m in (2, 3) for i in range(len(words) - m + 1))
        assert seen == want


def test_rank_table_is_bounded(spark):
    counts = spark.createDataFrame([("en", f"w{i}", 10 + i) for i in range(500)] + [("en", "rare", 9)], "lang string, word string, f long")
    table = phrases.ranks(counts, 10, 100)
    assert 0 < len(table.hashes) <= 100 and not table.complete and table.counts.min() > 400
    table = phrases.ranks(counts)
    assert len(table.hashes) == 500 and table.complete
    assert len(phrases.ranks(counts, 10, 1 << 17, 50).hashes) * 4 <= 50
    assert (np.diff(table.counts) <= 0).all()


def test_query_equals_its_sql(spark, sf_dir):
    from exalake.llm.queries import oracle_sql, queries

    frame = queries()["op12_phrases"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(con.execute(oracle_sql()["op12_phrases"]).fetchall())
