"""Queries over whole tables: no row of a table is left aside."""

import random

import duckdb
import pytest

from exalake.operators import answer_key
from exalake.plans.queries import ORACLES, QUERIES


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "documents", "lineitem", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    got, want = sorted(map(tuple, got.select(*names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert got == want
    return names, got


def test_every_key_is_paired(spark):
    sf = "/root/testdata/sf0.01"
    _, got = same_as_sql(spark, sf, "pair_key_files")
    assert len(got) == spark.read.parquet(f"{sf}/customer.parquet").count() and sum(x is not None for _, x in got) > 200


def test_every_document_is_normalised(spark):
    sf = "/root/testdata/sf0.01"
    _, got = same_as_sql(spark, sf, "normalise_texts")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharp = {r.doc_id for r in docs.where("lang = 'de' and contains(text, 'ß')").collect()}
    assert len(got) == docs.count() and sharp and sharp <= {i for i, *_ in got}


@pytest.mark.parametrize("name", ["overlapping_spans", "nearest_row_above", "nth_key_to_nth_question"])
def test_every_row_is_on_a_side(spark, name):
    sf = "/root/testdata/sf0.01"
    _, got = same_as_sql(spark, sf, name)
    if name == "overlapping_spans":
        assert {i // 10 % 4 for pair in got for i in pair} == {0, 1, 2, 3}
    else:
        table, key = ("events", "event_id % 2 = 0") if name.startswith("nearest") else ("orders", "o_orderkey % 2 <> 0")
        assert len(got) == spark.read.parquet(f"{sf}/{table}.parquet").where(key).count()


def paired(keys, exams):
    plain = lambda t: set(t) - set(answer_key.COMMON_WORDS)
    for i, a in keys:
        same = [e for e, b in exams if a and ".".join(a) == ".".join(b)]
        scores = [(len(plain(a) & plain(b)) / min(len(plain(a)), len(plain(b))), e) for e, b in exams if any(len(t) > 1 and not t.isdigit() for t in plain(a) & plain(b))]
        top = [e for s, e in scores if s == max(scores)[0] and s >= 0.8]
        yield i, (same[0] if len(same) == 1 else None) if same else top[0] if len(top) == 1 else None


def test_pair_names_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["de", "thi", "toan", "ly", "hoa", "a", "b", "12", "7", "lop", "hk1", "hk2", "van", "su"]
    made = lambda n, most: [(i, [rng.choice(words) for _ in range(rng.randint(0, most))]) for i in range(n)]
    keys, exams = made(300, 6), made(60, 9)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, tokens array<string>")
    got = answer_key.pair_names(frame(keys, "key_id"), frame(exams, "exam_id")).collect()
    want = sorted(paired(keys, exams))
    assert sorted((r.key_id, r.exam_id) for r in got) == want and sum(e is not None for _, e in want) > 20


@pytest.mark.parametrize("name", ["document_file_names", "normalise_texts"])
def test_marks_of_any_script(spark, tmp_path, name):
    texts = ["a\u0483b", "a\u0591b c\u20ddd", "a\u0e31b", "x" * 59 + "\u05b0yz", "\u00c9\u00e9", "\u212a\u0111", "\u0111\u0301a\u093eB", "\u00df1", "a\u0000b", "", None, "\u0939\u093f", "Cafe\u0301 \u1ec7\u0323x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    spark.read.parquet(f"{tmp_path}/documents").write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = QUERIES[name](spark, f"{tmp_path}/sf")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_nearest_above_reads_a_part_once(spark):
    """No frame begins at each row (that is quadratic in a part); rows at one place are taken by their values."""
    from exalake.operators import ordered

    rows = spark.createDataFrame([("s", 5, "b"), ("s", 5, "a"), ("s", 9, "c"), ("s", 9, "d"), (None, 3, "n")], "sheet string, at int, name string")
    marks = spark.createDataFrame([("s", 1, 1), ("s", 5, 2), ("s", 30, 3), (None, 1, 4), ("t", 1, 5)], "sheet string, at int, pic int")
    found = ordered.nearest_above(marks, rows, ["sheet"], "at", "name", "row")
    assert {r.pic: r.row for r in found.collect()} == {1: "a", 2: "b", 3: "d", 4: "n", 5: None}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "unboundedpreceding" in plan and "currentrow$(), unboundedfollowing" not in plan


def test_a_range_is_looked_up_once(spark, monkeypatch):
    """Questions of one exam, part and range ask the key once; each of them gets the answer, also where a name is missing."""
    looked = []
    once = answer_key.find_answers
    monkeypatch.setattr(answer_key, "find_answers", lambda q, k: looked.append(q.count()) or once(q, k))
    asked = [("e", i, "I" if i % 2 else "", 1, 2) for i in range(40)] + [("e", 90, None, 2, 4), (None, 91, "I", 1, 2), ("f", 92, "I", 1, 1)]
    q = spark.createDataFrame(asked, "exam string, qid long, part string, low int, high int")
    k = spark.createDataFrame([("e", "I", "1", "A"), ("e", "I", "2", "B"), ("e", "", "2-4", "C")], "exam string, part string, no string, value string")
    got = {r.qid: r.value for r in answer_key.find_range_answers(q, k).collect()}
    assert got == {**{i: "A, B" if i % 2 else None for i in range(40)}, 90: "C", 91: None, 92: None}
    assert looked == [3 + 3 + 4 + 3 + 2]


def test_each_answer_is_spelt_once(spark):
    """What a step of the spellings starts from stands in the expression once, so it isn't worked out again for each use."""
    from pyspark.sql import functions as F

    from exalake.functions import cells

    plan = spark.range(1).select(F.array(F.concat(F.lit("a-b "), F.col("id").cast("string"))).alias("said")).select(cells.short_variants(F.col("said"), loose=True).alias("v"))
    assert plan._jdf.queryExecution().analyzed().toString().count("said#") <= 4
    assert plan.first().v[:2] == ["a-b 0", "a b 0"]
    assert "Join" in QUERIES["short_answer_spellings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_move_before_they_are_sorted(spark):
    """Rows of ranges go to their numbers first; nothing is sorted on the side where they are made."""
    from exalake.operators import banks

    questions = spark.createDataFrame([(1, 4), (1, 9), (2, 4)], "exam int, no int")
    ranges = spark.createDataFrame([(1, 1, 1, 8), (1, 2, 3, 5), (1, 3, 4, 6)], "exam int, group int, low int, high int")
    found = banks.innermost_ranges(questions, ranges, "exam")
    assert {(r.exam, r.no): r.group for r in found.collect()} == {(1, 4): 3, (1, 9): None, (2, 4): None}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    made = plan[: plan.index("Generate")]
    assert "Exchange hashpartitioning" in made[made.rindex("Aggregate") :]


def test_fill_blanks_deals_lines_before_it_groups_them(spark, sf_dir):
    """Nearly every line is a group of its own: no task groups what it has read, and more tasks than usual share the groups."""
    from exalake.plans.queries import QUERIES

    plan = QUERIES["grade_fill_blanks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.count("RepartitionByExpression [l_orderkey") == 3 and plan.count(f", {tasks}\n") == 3
