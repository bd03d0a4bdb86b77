"""Exact k-means with norm-of-sum bounds (Elkan's scheme with ns-bounds).

Vectors and centroids are whole numbers, so distances are exact. Every vector keeps its cluster
and, for every centroid, a distance and the round in which it was measured. The centroids of all
rounds are kept too: a distance measured in round t is off by at most |c(now) - c(t)|, the norm of
the centroid's total displacement, which is never more than the sum of its moves per round. A
vector stays where it is, without a distance being computed, while its upper bound is below all
lower bounds. Otherwise the distance to its own centroid is measured, and then that to every
centroid whose lower bound does not exceed it; ties go to the smaller number.

Bounds are floats that are rounded outwards, decisions between measured distances are made on
integers, so the result equals that of a full scan in every round. Each round is one pass over a
table (vector, cluster, bounds) that is written again with what was measured; only sums per
cluster leave the executors. The history is rounds x centroids x components numbers.

Cases: vectors with another number of components, or with a null, NaN or infinite one, are left
out; a null vector too. Repeated rows are vectors of their own; a null id is hashed as if it had no
digits. With fewer vectors than centroids there are as many centroids as vectors; among equal
hashes the lexicographically smaller vector comes first. An empty cluster keeps its centroid. No
vectors give an empty result. A component of more than 2^26 once scaled is an error, as squared
distances must fit 64 bits. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.session import materialize

SEED = "1"
DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: The largest component: 4 * 64 * 2^52 is below 2^63.
LARGEST = 1 << 26
#: Distances worked on at once in a task.
BLOCK = 1 << 14
#: Relative error of a distance stored in 32 bits, a norm and their sum, with room to spare.
SLACK = 1e-6


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
           scale: int = SCALE) -> DataFrame:
    """(key, x): the vectors that count, every component as floor(scale * component)."""
    wide = vectors.select(F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = wide.filter((F.size("v") == dimensions) & finite)
    largest = F.lit(float(LARGEST))

    def whole(v):
        y = F.floor(v * scale)
        return F.when(F.abs(v * scale) <= largest, y).otherwise(F.raise_error(F.lit(f"a scaled component is above {LARGEST}"))).cast("int")

    return kept.select("key", F.transform("v", whole).alias("x"))


def first_centroids(points: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and key, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = points.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64) if rows else np.zeros((0, 0), dtype=np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Scan:
    """One assignment round over Arrow batches: carries the history of centroids and nothing else."""

    def __init__(self, history: list[np.ndarray], exact: bool = False):
        self.history, self.exact = np.stack(history), exact
        moved = (self.history[-1][None] - self.history).astype(np.float64)
        # moved[t, j]: how far centroid j is now from where it was in round t.
        self.moved = np.sqrt(np.einsum("tjd,tjd->tj", moved, moved)) * (1 + SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, dist: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
        """Reassign in place; returns the squared distances to the own cluster where they were measured
        (else -1) and how many distances were computed.

        ``dist[i, j]`` is the distance of vector i to centroid j in round ``seen[i, j]``."""
        now, (n, k) = len(self.history) - 1, dist.shape
        centroids, every, own = self.history[-1], np.arange(n), np.full(n, -1, dtype=np.int64)
        drift = self.moved[seen, np.arange(k)]
        lower = dist * (1 - SLACK) - drift
        upper = dist[every, cluster] * (1 + SLACK) + drift[every, cluster]
        others = lower.copy()
        others[every, cluster] = np.inf
        failed = np.flatnonzero(upper >= others.min(axis=1)) if k > 1 else np.zeros(0, dtype=np.int64)
        measure = every if self.exact else failed
        own[measure] = _squared(x[measure], centroids[cluster[measure]])
        dist[measure, cluster[measure]] = np.sqrt(own[measure])
        seen[measure, cluster[measure]] = now
        computed = len(measure)
        best_d, best_j = own[failed].copy(), cluster[failed].copy()
        for j in range(k):
            at = np.flatnonzero((cluster[failed] != j) & (lower[failed, j] <= np.sqrt(best_d) * (1 + SLACK)))
            rows = failed[at]
            d = _squared(x[rows], centroids[j])
            computed += len(rows)
            dist[rows, j] = np.sqrt(d)
            seen[rows, j] = now
            win = (d < best_d[at]) | ((d == best_d[at]) & (j < best_j[at]))
            best_d[at[win]], best_j[at[win]] = d[win], j
        cluster[failed], own[failed] = best_j, best_d
        return own, computed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = self.history.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
                cluster = part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                dist = part.column("dist").flatten().to_numpy(zero_copy_only=False).reshape(n, k).astype(np.float64)
                seen = part.column("seen").flatten().to_numpy(zero_copy_only=False).reshape(n, k).copy()
                own, computed = self.assign(x, cluster, dist, seen)
                spent = np.zeros(n, dtype=np.int64)
                spent[0] = computed
                yield self._batch(part, cluster, dist, seen, own, spent)

    @staticmethod
    def _batch(part, cluster, dist, seen, own, spent) -> pa.RecordBatch:
        n, k = dist.shape
        at = pa.array(np.arange(0, n * k + 1, k), pa.int32())
        lists = lambda values, kind: pa.ListArray.from_arrays(at, pa.array(values.ravel(), kind))
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("x"), pa.array(cluster, pa.int32()), lists(dist, pa.float32()),
             lists(seen, pa.int8()), pa.array(own, pa.int64()), pa.array(spent, pa.int64())],
            names=["key", "x", "cluster", "dist", "seen", "own", "computed"])


def assigned(state: DataFrame, history: list[np.ndarray], exact: bool = False) -> DataFrame:
    """One round: ``state`` (key, x, cluster, dist, seen) scanned against the last centroids of ``history``,
    with ``own`` (the squared distance, -1 where none was needed) and ``computed`` (distances, by block)."""
    schema = C.with_key(state, "x array<int>, cluster int, dist array<float>, seen array<tinyint>, own long, computed long")
    return state.select("key", "x", "cluster", "dist", "seen").mapInArrow(Scan(history, exact), schema)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every non-empty cluster's vectors; empty ones stay. One row a cluster is collected."""
    d = centroids.shape[1]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d))).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    return out


def kmeans(points: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, x, cluster, dist, seen, own, computed), centroids of every round) after ``rounds`` moves and a last
    assignment, in which ``own`` is every vector's squared distance."""
    if rounds > 126:
        raise ValueError("rounds are stored as single bytes")
    points = materialize(points, "points")
    history = [first_centroids(points, k, seed)]
    k = len(history[0])
    if not k:
        return points.select("key", "x", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("own", "long"), ("computed", "long")))), history
    # Nothing is known yet: distance 0 to all centroids makes every vector fail its bounds.
    state = points.select("key", "x", F.lit(0).alias("cluster"), F.array_repeat(F.lit(0.0).cast("float"), k).alias("dist"),
                          F.array_repeat(F.lit(0).cast("tinyint"), k).alias("seen"))
    for _ in range(rounds):
        state = materialize(assigned(state, history), "bounds")
        history.append(moved_centroids(state, history[-1]))
    return materialize(assigned(state, history, exact=True), "bounds"), history


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CLUSTERS,
             rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that counts."""
    state, history = kmeans(scaled(vectors, key, vector, dimensions), k, rounds, seed)
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(history[-1])]
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("own").alias("s")).collect()}
    # One row for each of the k centroids.
    about = vectors.sparkSession.createDataFrame(
        [(j, sums.get(j, 0), sum(sums.values()), h) for j, h in names], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.join(F.broadcast(about), F.col("cluster") == F.col("_cluster"))
    return out.select(F.col("key").alias(key), "cluster", F.col("own").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-component embeddings in 16 clusters after three rounds."""
    return clusters(C.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Full scans in every round, as DuckDB SQL."""
    ctes = [f"""v0 AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) AS r, x FROM (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
            f"c0 AS (SELECT CAST(r - 1 AS INT) AS j, x AS c FROM v0 WHERE r <= {CLUSTERS})"]
    for t in range(ROUNDS + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (
  SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT r, j, list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM v0, c{t}) GROUP BY r)""")
        if t < ROUNDS:
            ctes.append(f"""m{t} AS (
  SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM v0 JOIN a{t} USING (r), range(1, {DIMENSIONS + 1}) AS g(i) GROUP BY j, i) GROUP BY j)""")
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (j))")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, j AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v0 JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (j)
"""


OP11_SQL = _oracle()
