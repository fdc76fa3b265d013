"""Hamerly's bounds against clusters worked out without them."""

import hashlib
import math
import random

import duckdb
import numpy as np

from exalake.llm import centroids


def plain(rows, dims, k, rounds, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [q for _, q in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(centers)), key=lambda c: (far(q, centers[c]), c))
    for _ in range(rounds):
        own = [near(q) for _, q in kept]
        for c in range(len(centers)):
            if mine := [q for (_, q), o in zip(kept, own) if o == c]:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, near(q), far(q, centers[near(q)])) for i, q in kept]
    total = lambda c: sum(d for _, o, d in final if c in (None, o))
    return sorted(((i, c, d, total(c), total(None), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in final), key=repr)


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(5)
    # few distinct values give ties and repeated rows; one group holds a third of all
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0009765, 0.5, 1.0]) for _ in range(3)]) for i in range(90)] + [(100 + i, [0.25, 0.25, rng.random() / 50]) for i in range(45)]
    rows += rows[:7] + [(200, None), (201, []), (202, [0.1, None, 0.2]), (203, [0.1, float("nan"), 0.2]), (204, [float("inf"), 0.0, 0.0]), (205, [1.0, 2.0]), (None, [0.3, 0.2, 0.1]), (206, [131071.0, -131071.0, 9e4])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, id int")
    for k, rounds in ((1, 2), (5, 10), (8, 3), (8, 0)):
        got = centroids.clusters(frame, dims=3, k=k, rounds=rounds)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 3, k, rounds, "3")


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    assert {(r.vec_id, r.cluster, r.distance) for r in centroids.clusters(frame, dims=2).collect()} == {(1, 0, 0), (2, 0, 0)}
    none = centroids.clusters(frame.where("vec_id > 5"), dims=2)
    assert none.collect() == [] and dict(none.dtypes)["vec_id"] == "int"
    # beyond 2^17 a squared distance may pass 64 bits
    assert centroids.clusters(spark.createDataFrame([(1, [131072.0, 0.0])], "vec_id int, embedding array<double>"), dims=2).count() == 0


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(3)
    middle = rng.integers(-2000, 2000, (4, 16))
    q = middle[rng.integers(0, 4, 2000)] + rng.integers(-200, 200, (2000, 16))
    old = q[:4].tolist()
    cluster, upper, lower = centroids.scan(q, np.array(old))
    scanned = []
    for _ in range(8):
        new = [[int(x) for x in q[cluster == c].sum(0) // max(1, (cluster == c).sum())] for c in range(4)]
        cluster, upper, lower, n = centroids.assign(q, cluster, upper, lower, np.array(new), centroids.gaps(new), *centroids.moves(old, new))
        scanned.append(n)
        far = np.stack([np.sqrt(centroids.squared(q, np.array(c))) for c in new])
        assert (cluster == far.argmin(0)).all() and (upper >= far.min(0)).all() and (lower <= np.sort(far, 0)[1]).all()
        old = new
    assert scanned[-1] == 0 and sum(scanned) < 2 * len(q)


def test_query_equals_its_sql(spark, sf_dir):
    from exalake.llm.queries import oracle_sql, queries

    got = sorted(map(tuple, queries()["op11_centroids"](spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(oracle_sql()["op11_centroids"]).fetchall()) and len(got) == con.execute("SELECT count(*) FROM embeddings").fetchone()[0]
