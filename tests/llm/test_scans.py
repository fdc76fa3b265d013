"""Personal data, decontamination, WARC and the classifiers on small cases against plain versions."""

import base64
import hashlib
import io
import random
import re

import numpy as np
import pytest

from exalake.llm import decontaminate, pii, quality, toxicity, warc
from exalake.llm.text_arrays import Words, lower_bytes, prefix_hashes, span_hashes, utf8


def plain_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    atoms = list("0123456789") * 2 + [".", ".", "@", "@", "+", "-", " ", "(", ")", "a", "b.", "com", "%", "1.2.3.4", "4111111111111111", "\n", "é"]
    for _ in range(6000):
        x = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(x) == plain_spans(x)


def test_field_adds_without_touching():
    field = pii.trained_field()
    text = 'mail a.b@c.de ok, token = "0123456789abcdef0123456789abcdef" and version 3.14, acct 1234567890123456 end'
    base, spans = pii.find(text, field)
    assert [s[0] for s in base] == ["email"] and set(base) <= set(spans)
    assert "secret" in {k for k, *_ in spans} and "3.14" not in {text[a:b] for _, a, b in spans}
    found, total = 0, 0
    for text, gold in pii.samples(80, seed=99):  # held out
        spans = set(pii.find(text, field)[1])
        found += sum((a, b) in {(x, y) for _, x, y in spans} for _, a, b in gold)
        total += len(gold)
    assert found / total > 0.85
    assert pii.find(None, field) == ([], []) and pii.find("", field) == ([], [])
    assert len(pii.find("1.2.3.4 " * 3000, field)[0]) == 3000


def test_pii_frame(spark):
    docs = spark.createDataFrame([(1, "x 1.2.3.4 y", 0), (None, None, 0), (2, "", 0)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.digest_columns(pii.personal_data(docs)).collect()}
    assert rows[1].n_ip == 1 and rows[1].base_sha256 == hashlib.sha256(b"ip:2:9").hexdigest() and rows[1].spans == "ip:2:9"
    assert rows[None].base_sha256 == rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.text for r in pii.redact(docs).collect()} == {"x [ip] y", None, ""}


def semiglobal(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, q in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != q)))
        prev = cur
    return min(prev)


def test_edit_search_equals_brute_force():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(["ab", "ba", "cab", "abc", "cc", "da"]) for _ in range(rng.randint(5, 30)))) for i in range(12)]
    block, hits = decontaminate.ItemBlock(items, 0.1), 0
    for _ in range(120):
        _, p = rng.choice(items)
        q = list(p)
        for _ in range(rng.randint(0, int(len(p) * 0.14))):
            j, o = rng.randrange(len(q)), rng.random()
            if o < 0.33:
                q[j] = rng.choice("abcd ")
            elif o < 0.66:
                q.insert(j, rng.choice("abcd"))
            else:
                q.pop(j)
        x = " ".join(rng.choice(["ab", "ba", "cab"]) for _ in range(rng.randint(0, 8))) + "\n" + "".join(q).upper() + " ba"
        n = decontaminate.normal
        want = [i for i, p in items if semiglobal(n(p), n(x)) <= int(0.1 * len(n(p)) + 1e-9)]
        assert [i for i, _ in block.search([x, None, ""])[0]] == want
        hits += len(want)
    assert hits > 50


def test_decontamination_frames(spark):
    item = "these are the seven words of item one"
    items = spark.createDataFrame([(1, item), (2, None), (None, "too short"), (3, "another item with quite other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"lead {item} tail", "a"), (1, f"lead {item} tail", "a"), (2, "clean", "b"), (None, None, "c"), (4, "", "d")], "doc_id long, text string, item_id string")
    assert sorted((r.doc_id, r.distance) for r in decontaminate.contaminations(docs, items).collect()) == [(1, 0), (1, 0)]
    assert sorted(r.item_id for r in decontaminate.decontaminate(docs, items).collect()) == ["b", "c", "d"]
    assert decontaminate.contaminations(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert len(list(decontaminate.item_blocks(items, block_chars=10))) > 1


def test_warc_round_trip(spark, tmp_path):
    big = "a" * 2_500_000 + "é"
    pages = spark.createDataFrame([(1, "u", big), (2, None, None), (3, "u", ""), (None, "x", "q"), (5, "x", "q"), (5, "x", "q"), (6, "http://y/ä b", big)], "page_id long, url string, html string")
    rows = warc.archive_round_trip(pages, f"file://{tmp_path}/w").collect()
    assert len(rows) == 7 and all(r.digest_ok for r in rows)
    for r in rows:
        body = {1: big, 2: "", 3: "", None: "q", 5: "q", 6: big}[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(1, "revisit", 6), (2, "revisit", 3), (3, "response", None), (None, "revisit", 5), (5, "response", None), (6, "response", None)}
    assert {r.uri for r in rows if r.page_id == 6} == {"http://y/ä b"}
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    all_response = warc.archive_round_trip(pages.where("page_id in (2, 3)"), f"file://{tmp_path}/m", min_bytes=1)
    assert {r.record_type for r in all_response.collect()} == {"response"}


def test_warc_chunks_carry_digests(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.payload_chunks(pages, "page_id", "url", "html", chunk_bytes=4), f"file://{tmp_path}/c")
    rows = warc.read_archives(manifest, chunk_bytes=3).orderBy("chunk_no").collect()
    assert [bytes(r.payload) for r in rows] == [b"abc", b"def", b"ghi", b"j"]
    assert [r.payload_bytes for r in rows] == [3, 6, 9, 10] and [r.is_last for r in rows] == [False, False, False, True]
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(b"abcdefghij"[: r.payload_bytes]).digest()).decode() for r in rows)


def test_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(__import__("gzip").compress(b"WARC/1.1\r\nWARC-Type: response\r\n"))))


def test_word_hashes():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["Ab ÉC  ab", None, "éc\nab", ""]))
    low = lower_bytes(data)
    words = Words(low, offsets)
    h = span_hashes(prefix_hashes(low), words.start, words.end)
    assert words.doc.tolist() == [0, 0, 0, 2, 2] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("run", "label", "least"), [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.75)])
def test_held_out_accuracy(spark, run, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = run(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (None, None, 0), (2, "", 0), (2, "", 0)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for run in (quality.quality, toxicity.toxicity):
        assert len(run(docs, labels).collect()) == 4
        assert run(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.reject_toxic(docs, labels).columns == docs.columns


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    a, b, c = np.uint64(11), np.uint64(22), np.uint64(33)
    docs, y = [], []
    for _ in range(600):
        has = rng.random(2) < 0.5
        docs.append(np.unique(np.array([c] + [t for t, h in zip((a, b), has, strict=True) if h], np.uint64)))
        y.append(float(has.all()))
    model = toxicity.fit(docs, np.array(y), steps=600)
    assert set(model.term.tolist()) >= {11, 22}
    i, j = np.searchsorted(model.term, [a, b])
    assert model.vector[i] @ model.vector[j] > 0.5


def test_field_decodes_the_best_segmentation():
    """Viterbi against every segmentation and labelling of short texts."""
    from exalake.llm import pii

    field = pii.trained_field()
    names = ("O", *pii.KINDS)

    def best(text, tokens):
        cand = field.candidates(text, tokens)
        score = {(i, j, k): field.score(k, f) for j in range(len(tokens) + 1) for i, f in cand[j] for k in pii.KINDS} | {(j - 1, j, "O"): 0.0 for j in range(1, len(tokens) + 1)}

        def from_(at, prev):
            if at == len(tokens):
                return 0.0
            return max(score[s] + field.weights.get(f"{prev}>{s[2]}", 0.0) + from_(s[1], s[2]) for s in score if s[0] == at)

        return from_(0, "O"), score

    for text in ("tel +1 555", "key = a1b2", "x@y.de 12", "9 1.2"):
        tokens = [m.span() for m in pii._TOKEN.finditer(text)]
        want, score = best(text, tokens)
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
        spans = {starts[a]: (starts[a], ends[b], k) for k, a, b in field.decode(text, tokens)}
        got, at, prev = 0.0, 0, "O"
        while at < len(tokens):
            s = spans.get(at, (at, at + 1, "O"))
            got, at, prev = got + score[s] + field.weights.get(f"{prev}>{s[2]}", 0.0), s[1], s[2]
        assert abs(got - want) < 1e-9 and names


def test_regions_of_long_unspaced_texts():
    import time

    from exalake.llm import pii

    began = time.time()
    assert list(pii.regions("a1" * 500_000)) == [(0, 1_000_000)]
    assert len(list(pii.regions("a b c d 1 e f g h " * 20_000))) == 20_000
    assert time.time() - began < 20
