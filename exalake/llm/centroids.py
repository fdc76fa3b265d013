"""Clusters around centroids in exact integers, with Hamerly's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to the second
nearest one.  When centroids move, the bounds loosen by the moves: no vector is looked at.  Only where they don't tell the
nearest centroid any more is the own distance worked out, and if that doesn't tell either, all centroids are scanned in exact
integers.  Bounds are rounded away from the truth, so a vector that they settle is the same as a scanned one.

A round is one pass over a written table of vectors and bounds, without a shuffle; centroids follow from the vectors that
changed their cluster.  The driver holds k centroids and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.text_arrays import drop, materialise

SCALE = 1024
#: Integer components stay below this, so that squared distances of up to 128 components fit in 64 bits.
MOST = 1 << 27
#: A few units in the last place: more than what a root and a sum round off.
SLACK = 8 * np.finfo(np.float64).eps

STATE = "id {id}, q array<int>, cluster int, before int, upper double, lower double"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, q): floor(SCALE * component) of the vectors with `dims` components, none of them null, non-finite or so large that
    its integer reaches MOST."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.forall(x, lambda v: F.coalesce(F.abs(v) < MOST // SCALE, F.lit(False)))  # NaN is larger than any number
    return vectors.where((F.size(x) == dims) & usable).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id` in ascending order (null ids last; equal ids by their components)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.q) for r in rows.select(key.alias("key"), "q").orderBy(F.col("key").asc_nulls_last(), "q").limit(k).collect()]


def squared(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = q - centroid
    return np.einsum("ij,ij->i", d, d)


def gaps(centroids: list[list[int]]) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one, rounded down: nearer vectors have no other nearest."""
    out = [min((math.isqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for j, y in enumerate(centroids) if j != i), default=math.inf) / 2 for i, x in enumerate(centroids)]
    return np.array(out) * (1 - SLACK)


def moves(old: list[list[int]], new: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far the others moved at most, both rounded up."""
    own = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(old, new, strict=True)]) * (1 + SLACK)
    return own, np.array([max(np.delete(own, i), default=0.0) for i in range(len(own))])


def scan(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equally near ones), an upper bound of its distance, a lower one of the second's."""
    far = np.stack([squared(q, c) for c in centroids])
    best = far.argmin(axis=0)
    near = far[best, np.arange(len(q))]
    if len(centroids) == 1:
        return best, np.sqrt(near) * (1 + SLACK), np.full(len(q), np.inf)
    return best, np.sqrt(near) * (1 + SLACK), np.sqrt(np.partition(far, 1, axis=0)[1]) * (1 - SLACK)


def assign(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, gap: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, scanned) after the centroids moved."""
    cluster, upper = cluster.copy(), (upper + own[cluster]) * (1 + SLACK)
    lower = np.maximum(lower * (1 - SLACK) - others[cluster], 0)
    open_ = np.flatnonzero(upper >= np.maximum(lower, gap[cluster]))
    upper[open_] = np.sqrt(squared(q[open_], centroids[cluster[open_]])) * (1 + SLACK)
    open_ = open_[upper[open_] >= np.maximum(lower[open_], gap[cluster[open_]])]
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = scan(q[open_], centroids)
    return cluster, upper, lower, len(open_)


def _components(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _passes(centroids: list[list[int]], moved: tuple[np.ndarray, np.ndarray] | None) -> Callable:
    """The pass that gives each vector its cluster and bounds; without `moved` the first one, which scans all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, gap = np.array(centroids, np.int64), gaps(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _components(batch)
            if moved is None:
                before = np.full(len(q), -1, np.int32)
                cluster, upper, lower = scan(q, c)
            else:
                before = batch.column("cluster").to_numpy()
                cluster, upper, lower, _ = assign(q, before, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), c, gap, *moved)
            columns = [batch.column("id"), batch.column("q"), *map(pa.array, (cluster.astype(np.int32), before, upper, lower))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "q", "cluster", "before", "upper", "lower"])

    return run


def _changes(k: int, dims: int) -> Callable:
    """Of a partition: what vectors that came and left add to each cluster's component sums and (last) its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            q = np.hstack([_components(batch), np.ones((batch.num_rows, 1), np.int64)]) if batch.num_rows else np.zeros((0, dims + 1), np.int64)
            left = batch.column("before").to_numpy()
            np.add.at(total, batch.column("cluster").to_numpy(), q)
            np.subtract.at(total, left[left >= 0], q[left >= 0])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


def _moved_sums(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """k rows of component sums and a count, of the vectors whose cluster is another one than before."""
    parts = state.where("cluster <> before").select("q", "cluster", "before").mapInArrow(_changes(k, dims), "cluster int, sums array<long>")
    summed = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out = [[0] * (dims + 1) for _ in range(k)]
    for r in summed.collect():  # k * (dims + 1) rows at most
        out[r.cluster][r.pos] = int(r.total)
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, a null or non-finite one, or one of 2^17 or more in size (whose distances would
    not fit in 64 bits) are left out; so is a null vector.  Repeated rows count as often as they stand; null ids stay and come
    last when the first centroids are chosen.  Fewer than k usable vectors give as many clusters; none, an empty result.
    A sum that doesn't fit in 64 bits is null.  Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = materialise(integer_vectors(vectors, id_col, vector_col, dims), "vectors")
    centroids = first_centroids(rows, k, seed)
    sums = [[0] * (dims + 1) for _ in centroids]
    state, moved = rows, None
    for _ in range(rounds if centroids else 0):
        earlier, state = state, materialise(state.mapInArrow(_passes(centroids, moved), STATE.format(id=kind)), "bounds")
        drop(earlier)
        change = _moved_sums(state, len(centroids), dims)
        sums = [[a + b for a, b in zip(s, c, strict=True)] for s, c in zip(sums, change, strict=True)]
        new = [[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids, strict=True)]
        if new == centroids:  # every later round would repeat this one
            moved = moves(centroids, new)
            break
        centroids, moved = new, moves(centroids, new)
    return _report(state, centroids, moved, kind, id_col)


def _report(state: DataFrame, centroids: list[list[int]], moved: tuple[np.ndarray, np.ndarray] | None, kind: str, id_col: str) -> DataFrame:
    """Assigns a last time; exact distances, their sums and the digest of the centroid for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in _passes(centroids, moved)(batches):
            cluster = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(squared(_components(batch), c[cluster]))], ["id", "cluster", "distance"])

    last = materialise(state.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    drop(state)
    inertia = {r.cluster: int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    as_long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))
    return last.select(
        F.col("id").alias(id_col), "cluster", "distance", of([as_long(inertia.get(i, 0)) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        as_long(sum(inertia.values())).alias("inertia"), of([F.lit(x) for x in digest], "string").alias("centroid_sha256"),
    )


def clusters_sql(dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """The same rows as DuckDB SQL over `embeddings`, every distance worked out in every round."""
    far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: CAST((v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) AS BIGINT)))"
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
FROM embeddings WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS INTEGER) AS c, q FROM v QUALIFY c < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.rid, min({{'d': CAST({far} AS BIGINT), 'c': c.c}}) AS best FROM v, c{r} AS c GROUP BY v.rid)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{r} AS o LEFT JOIN (
SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS q FROM (SELECT a.best.c AS c, i, sum(v.q[i]) AS s, count(*) AS n FROM a{r} AS a JOIN v USING (rid), range(1, {dims + 1}) AS g(i) GROUP BY ALL) GROUP BY c) AS n USING (c))""")
    return ",\n".join(parts) + f"""
SELECT v.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (rid) JOIN c{rounds} AS c ON c.c = a.best.c"""
