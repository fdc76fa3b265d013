"""Places of matches, models and secrets against plain versions and SQL."""

import collections
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from exalake.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_base(x):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32])


def plain_model(samples):
    n = [collections.Counter(), collections.Counter()]
    for text, label in samples:
        for a, b in zip(text or "", (text or "")[1:]):
            for p in {a + b} if label else {a + b, (a + b).upper(), (a + b).replace("_", "-"), (a + b).replace("_", "/")}:
                if set(p) <= set(secrets.ALPHABET) and set(a + b) <= set(secrets.ALPHABET):
                    n[label][p] += 1
    total = [collections.Counter(), collections.Counter()]
    for label in (0, 1):
        for p, v in n[label].items():
            total[label][p[0]] += v
    chance = lambda label, p: (n[label][p] + 0.5) / (total[label][p[0]] + 0.5 * secrets.SIZE)
    return {a + b: math.floor(math.log(chance(1, a + b) / chance(0, a + b)) * 1000 + 0.5) for a in secrets.ALPHABET for b in secrets.ALPHABET}


def plain_spans(x, model):
    base = plain_base(x)
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", x):
        score = sum(model[a + b] for i, (a, b) in enumerate(zip(m[0], m[0][1:])) if (i + 1) % secrets.PIECE)
        if score >= (len(m[0]) - 1) * secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return base, sorted(out)


def shown(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(8)
    words = ["user", "name", "getValue", "connection", "index", "2024", "https", "local", "main-entry", "file_path"]
    return [("_" + rng.choice(words) + "_" + rng.choice(words), 0) for _ in range(3000)] + [("".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(40)), 1) for _ in range(2000)] + [(None, 0), ("", 1), ("é", 0)]


def test_spans_equal_plain_ones(spark, samples):
    model = secrets.train(spark.createDataFrame(samples, "text string, label int"))
    plain = plain_model(samples)
    assert {secrets.ALPHABET[r.id // secrets.SIZE] + secrets.ALPHABET[r.id % secrets.SIZE]: r.weight for r in model.collect()} == plain
    rng = random.Random(4)
    atoms = ["token", "API_key", "passwd=", "Secret", '"', "'", " ", ":", "=", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "abc", "é", "\n", "ſecret", "x" * 7, "userName", "Zq3kP9vXw2LmT8sR", "-", ".", "/", "_", "𝒳"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "token:secret:abcdefghi", "token = " + "a" * 8, "Zq3kP9vXw2LmT8sR " * 700, ("0123456789abcdef" * 2 + " ") * 500, "Zq3kP9vXw2LmT8sR" * 100, "é" * 5 + " deadbeef" * 8]
    frame = spark.createDataFrame([(i % 1400, t, "x", 1) for i, t in enumerate(texts)] + [(None, "token=12345678", "", 0)], "doc_id int, text string, spans string, base int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.spans, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.digest_columns(secrets.secrets(frame, model)).collect())
    want = []
    for i, t in [(i % 1400, t) for i, t in enumerate(texts)] + [(None, "token=12345678")]:
        base, spans = plain_spans(t or "", plain)
        n = [sum(k == x for _, k, _ in base) for x in range(3)]
        want.append((i is None, i or 0, shown(spans), hashlib.sha256(shown(base).encode()).hexdigest(), *n))
    assert got == sorted(want) and sum("random" in w[2] for w in want) > 50
    assert secrets.secrets(frame.where("doc_id < 0"), model).collect() == []


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 1000, 5000)]
    got = spark.createDataFrame([(x,) for x in rows], "x array<int>").select("x", secrets.running(F.col("x")).alias("s")).collect()
    for r in got:
        assert list(r.s) == [sum(r.x[:i]) for i in range(len(r.x))]


def test_models_tell_random_strings_from_identifiers(spark, sf_dir):
    model = secrets.trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = random.Random(6)
    made = ["".join(rng.choice(a) for _ in range(n)) for a in (secrets.ALPHABET[:62], secrets.ALPHABET[26:62], "0123456789abcdef", secrets.ALPHABET) for n in (20, 32, 40) for _ in range(25)]
    plain = ["org_apache_sql_functions", "MAX_CONNECTION_TIMEOUT", "4111111111111111", "-" * 30, "thernderinaning", "content-management-system"]
    rows = spark.createDataFrame([(t,) for t in made + plain], "t string").select("t", secrets.ratio(F.col("t"), secrets.weights(model)).alias("r")).collect()
    secret = {r.t for r in rows if r.r >= (len(r.t) - 1) * secrets.THRESHOLD}
    assert not secret & set(plain) and len(secret & set(made)) >= 0.95 * len(made)


def test_no_python_worker(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = secrets.secrets(docs, secrets.trained(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)


def test_query_equals_its_sql(spark, sf_dir):
    from exalake.llm.queries import oracle_sql, queries

    frame = queries()["op13_secrets"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, frame.collect())) == sorted(con.execute(oracle_sql()["op13_secrets"]).fetchall())
