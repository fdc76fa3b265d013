"""Line dedup, near-duplicates and fingerprints against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from exalake.llm import fingerprints, line_dedup, near_dedup


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 20)))
    pool = [line() for _ in range(60)]

    def vary(x):
        w = x.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w)

    docs = [(i, "\n".join([vary(rng.choice(pool)) if rng.random() < 0.7 else line() for _ in range(rng.randint(1, 6))])) for i in range(150)]
    return docs + [(150, None), (151, ""), (152, "short"), (None, docs[3][1]), (7, docs[7][1]), (8, docs[9][1])]


def line_sets(text):
    return [(k, frozenset(w for w in x.lower().split(" ") if w)) for k, x in enumerate(text.split("\n")) if len(x.strip(" ")) >= line_dedup.LEAST_CHARS]


def test_line_dedup_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, 0) for i, t in corpus], "doc_id long, text string, n_lines int")
    hashes = {r.text: r.h for r in line_dedup.numbered(docs, "doc_id", "text").collect()}
    places = sorted({(i is None, i or 0, hashes[t or ""], t or "") for i, t in corpus})
    seen, gone = [], {}
    for nul, i, _, t in places:
        for k, s in line_sets(t):
            if any(len(s & o) * 5 >= len(s | o) * 4 for o in seen):
                gone.setdefault((None if nul else i, t), set()).add(k)
            seen.append(s)
    rows = line_dedup.line_report(docs).collect()
    assert len(rows) == len(corpus) and sum(map(len, gone.values())) > 50
    want = sorted((-1 if i is None else i, sorted(gone.get((i, t or ""), ()))) for i, t in corpus)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.removed) for r in rows) == want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = sorted((-1 if i is None else i, t if not gone.get((i, t or "")) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in corpus if t is not None)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect() if r.text is not None) == texts
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_many_variants_of_one_line(spark):
    words = [f"word{i}" for i in range(20)]
    docs = [(i, " ".join(words[: i % 20] + [f"x{i}"] + words[i % 20 + 1 :])) for i in range(200)]
    got = line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == set(range(1, 200))


def test_frequent_tokens_equal_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "MANY_PREFIXES", 3)
    test_line_dedup_equals_brute_force(spark, corpus)


def test_lines_of_a_frequent_token_are_not_paired(spark, monkeypatch):
    """The first line has three words of its own, the others two: they are similar to each other, not to the first one."""
    words, n, sizes = [f"word{i}" for i in range(40)], 1100, {}

    def line(i):
        own = {(i * 7 + 13 * j) % 40: f"x{i}y{j}" for j in range(2 + (i == 0))}
        return " ".join(own.get(k, w) for k, w in enumerate(words))

    def counted(df, name, **options):
        out = materialise(df, name, **options)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    materialise = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", counted)
    got = line_dedup.line_report(spark.createDataFrame([(i, line(i)) for i in range(n)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {0, 1}
    assert max(sizes.values()) < 60 * n, sizes  # paired: 543,162


def test_similar_lines_of_rare_tokens_are_not_paired(spark, monkeypatch):
    """A cluster of 400 similar lines, below MANY_PREFIXES; a set of two tokens in two orders."""
    words, n, sizes = [f"word{i}" for i in range(40)], 400, {}
    cluster = [" ".join({(i * 7 + 13 * j) % 40: f"x{i}y{j}" for j in range(2)}.get(k, w) for k, w in enumerate(words)) for i in range(n)]

    def counted(df, name, **options):
        out = materialise(df, name, **options)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    materialise = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", counted)
    got = line_dedup.line_report(spark.createDataFrame(list(enumerate([*cluster, "a b", "B  a"])), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {0, n}
    assert max(sizes.values()) < 60 * n, sizes  # paired: 79,800


def test_short_lines_take_part(spark):
    docs = [(1, "Les.\n\nAll rights reserved.\na b c d"), (2, "Les.\n\nall  rights reserved.\n "), (3, "a b c d e\nles.\nx\na b c"), (4, "x\n\t\n\t")]
    got = {r.doc_id: r.removed for r in line_dedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 2], 3: [0, 1], 4: [0, 2]}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: docs[0][1], 2: "\n ", 3: "x\na b c", 4: "\t"}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


@pytest.mark.parametrize("scalar", [128, 2])
def test_banded_distance(monkeypatch, scalar):
    monkeypatch.setattr(near_dedup, "SCALAR_EDITS", scalar)
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        b = a[:]
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randint(0, len(b)), rng.randrange(4)) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        limit = rng.randint(0, 12)
        assert near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == min(distance(a, b), limit + 1)


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 90))] for _ in range(25)]
    docs, truth = [], {}
    for n, b in enumerate(base):
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = b[:]
            for _ in range(rng.randint(0, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            truth[len(docs)] = n
            docs.append((len(docs), " ".join(w), 1))
    docs += [(900, None, 1), (901, "", 1), (902, " \n", 1), (903, "", 1), (904, docs[0][1], 1), (904, docs[0][1], 1), (None, docs[0][1], 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, keep int")
    rows = near_dedup.near_duplicates(frame).collect()
    assert len(rows) == len(docs)
    class_of = {r.doc_id: r.class_id for r in rows}
    for i, n in truth.items():
        assert class_of[i] == min(j for j, m in truth.items() if m == n)
    assert class_of[904] == class_of[None] == class_of[0] and [class_of[i] for i in (900, 901, 902, 903)] == [900, 901, 902, 903]
    assert {r.doc_id for r in rows if r.keep} == {min(j for j, m in truth.items() if m == n) for n in range(25)} | {900, 901, 902, 903}
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == 29
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_large_bucket_keeps_links(spark, monkeypatch):
    """Groups that meet in one bucket by a shared passage: centre rounds must not lose or add links."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "PAIRED_OUTRIGHT", 3)
    rng = random.Random(6)
    shared = " ".join(f"common{i}" for i in range(40))
    docs = []
    for g in range(6):
        own = [f"g{g}w{i}" for i in range(25)]
        for _ in range(4):
            w = own[:]
            w[rng.randrange(25)] = f"z{rng.randrange(10**6)}"
            docs.append((len(docs), f"{shared} {' '.join(w)}"))
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i - i % 4 for i in range(24)}


def pieces(t):
    return {x.strip(" ") for x in re.findall(r"[^\n]{1,120}[^.!?\n]{0,400}[.!?]*", t)}


def test_fingerprints(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(2, 14))) + rng.choice([". ", "! ", "\n"])
    docs = [(i, "".join(sentence() for _ in range(rng.choice([0, 1, 3, 10, 40, 300])))) for i in range(0, 60, 2)]
    docs += [(None, "null id. here"), (61, None)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in fingerprints.edit_fingerprints(frame).collect()}
    order = sorted((d for d in docs if d[0] is not None), key=lambda d: -d[0]) + [docs[-2]]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        f = len(t) // 3
        edited = t[: len(t) - f] + nxt[:f]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(set(r.near_edited_digests)) == len(r.near_edited_digests) == len(pieces(t) ^ pieces(edited))
        assert r.near_edited == pytest.approx(like(pieces(t), pieces(edited))) and r.near_next == pytest.approx(like(pieces(t), pieces(nxt)))
    assert fingerprints.edit_fingerprints(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b. c"), (2, "a b. c"), (2, "a b. c")], "doc_id long, text string")
    assert fingerprints.edit_fingerprints(same).select("fingerprint").distinct().count() == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    out, frame = corpus_pipeline.run(spark, sf), docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        frame.write.parquet(f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "sentencepiece":
            assert frame.columns == docs.columns
    assert 0 < out.count() == frame.count() < docs.count()
    assert out.where("not lossless").count() == 0


def test_clashing_columns(spark):
    """Extra columns named like the operators' own stay as they are."""
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f\nnew line", 9, 10, 11, 12)], "doc_id long, text string, removed int, d_id int, gone_id int, id int")
    assert [tuple(r) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [(1, "a b c d e f", 5, 6, 7, 8), (2, "new line", 9, 10, 11, 12)]
    same = docs.withColumn("text", F.lit("one two three four five six seven"))
    assert [tuple(r)[2:] for r in near_dedup.keep_one(same).collect()] == [(5, 6, 7, 8)]


def test_classes_equal_brute_force(spark):
    """Classes are the components of all pairs that are similar; pairs here are far closer than the threshold or far apart."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    docs, words = [], []
    for _ in range(20):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.choice([1, 3, 6])):
            w = base[:]
            for _ in range(rng.randint(0, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
            words.append(w)
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if abs(len(words[i]) - len(words[j])) <= 40 and 1 - distance(words[i], words[j]) / max(len(words[i]), len(words[j])) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(root))


def test_recall_by_edits():
    """The share of pairs that meet in a sketch, by the share of words replaced: at least 0.85 even at the threshold itself."""
    rng = np.random.default_rng(5)
    for share, least in ((0.05, 1.0), (0.1, 0.99), (0.15, 0.95), (0.2, 0.85)):
        met = 0
        for _ in range(60):
            a = rng.integers(0, 2**62, 300, dtype=np.uint64)
            b = a.copy()
            at = rng.choice(300, int(300 * share), replace=False)
            b[at] = rng.integers(0, 2**62, len(at), dtype=np.uint64)
            rows = near_dedup.order_min_hash(np.concatenate([a, b]), np.array([0, 300, 600]))
            met += bool((rows[0] == rows[1]).any())
        assert met / 60 >= least - 0.05, share


def test_members_of_one_passage_are_not_paired(spark, monkeypatch):
    """Texts that are alike in one long passage share buckets; only those alike in the rest as well are compared, and none is lost."""
    compared, write = [], near_dedup.materialise

    def counted(df, name, **options):
        out = write(df, name, **options)
        compared.extend([out.count()] if out.columns == ["a", "b"] and name != "links" and name != "edges" else [])
        return out

    monkeypatch.setattr(near_dedup, "materialise", counted)
    passage = [f"common{i}" for i in range(500)]
    texts = [" ".join([*passage, *[f"own{n}x{i}" for i in range(200)]]) for n in range(90)]
    texts.append(texts[50].replace("own50x7 ", "other ").replace("own50x90 ", "another "))
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {n: n if n < 90 else 50 for n in range(91)}
    assert sum(compared) < 1500, compared
