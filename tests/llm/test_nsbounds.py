import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detlens.llm import nsbounds as N


def brute(rows, k=N.CLUSTERS, rounds=N.ROUNDS, dims=N.DIMENSIONS):
    """Full scans with Python integers: (key, cluster, distance, cluster inertia, inertia, centroid hash)."""
    points = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v):
            points.append((key, tuple(math.floor(64 * float(np.float32(e))) for e in v)))
    name = lambda key: hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    centroids = [list(x) for _, x in sorted(points, key=lambda p: (name(p[0]), p[1]))[:k]]

    def assign():
        out = []
        for _, x in points:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, at) in zip(points, where) if at == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    where = assign()
    inertia = [sum(d for d, at in where if at == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((key, j, d, inertia[j], sum(inertia), sha[j]) for (key, _), (d, j) in zip(points, where)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def vectors(n, groups, seed, spread=0.1):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.4) for _ in range(64)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, spread) for m in middle[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("n,groups,spread", [(400, 5, 0.1), (300, 30, 0.02), (200, 1, 0.005)])
def test_equals_a_full_scan(spark, n, groups, spread):
    rows = vectors(n, groups, n, spread)
    assert got(N.clusters(frame(spark, rows))) == brute(rows)


def test_ties_copies_and_odd_vectors(spark):
    rng = random.Random(1)
    same = [0.25] * 64
    rows = vectors(60, 4, 9) + [(100 + i, same) for i in range(80)]  # a vector that most rows share
    rows += [(5, same), (5, same), (None, same), (None, [float(x % 3) for x in range(64)])]
    rows += [(200 + i, [rng.choice((-1.0, 1.0)) for _ in range(64)]) for i in range(30)]  # equal distances
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + same[1:]),
             (306, [float("inf")] + same[1:]), (307, [float("-inf")] + same[1:]), (308, [-1e-9] + [0.0] * 63), (309, [1e6] * 64)]
    df = frame(spark, rows).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("key", "x", "cluster", "dist", "seen", "own", "_cluster"))))
    assert got(N.clusters(df)) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(7, 7, 2) + [(3, [0.0] * 64)]
    assert got(N.clusters(frame(spark, rows))) == brute(rows)
    assert got(N.clusters(frame(spark, rows[:1]))) == brute(rows[:1])
    assert got(N.clusters(frame(spark, []))) == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="scaled component"):
        N.clusters(frame(spark, [(1, [2e7] * 64)])).collect()


def test_bounds_hold_and_save_distances(spark):
    """Every stored distance, loosened by the centroid's total displacement, encloses the true one;
    later rounds compute fewer distances than a full scan and than bounds loosened by each round's move."""
    rows = vectors(2000, 16, 4, 0.05)
    state, history = N.kmeans(N.scaled(frame(spark, rows)), rounds=6)
    data = state.collect()
    x = np.array([r["x"] for r in data], dtype=np.int64)
    dist, seen = (np.array([r[c] for r in data]) for c in ("dist", "seen"))
    scan = N.Scan(history)
    drift = scan.moved[seen, np.arange(16)]
    true = np.sqrt(((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2))
    assert (dist * (1 - N.SLACK) - drift <= true).all() and (true <= dist * (1 + N.SLACK) + drift).all()
    summed = sum(np.sqrt(((a - b) ** 2).sum(axis=1)) for a, b in zip(history, history[1:]))
    assert (scan.moved[0] <= summed * (1 + 1e-5)).all()
    assert state.agg(F.sum("computed")).first()[0] < 0.5 * 16 * len(rows)


def test_a_scan_measures_only_what_its_bounds_leave_open():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (5, 8))
    x = centres[rng.integers(0, 5, 500)] + rng.integers(-5, 6, (500, 8))
    state = [np.zeros(500, dtype=np.int64), np.zeros((500, 5)), np.zeros((500, 5), dtype=np.int8)]
    _, first = N.Scan([centres]).assign(x, *state)
    assert first == 500 * 5
    own, again = N.Scan([centres, centres + 1]).assign(x, *state)
    assert again == 0 and (own == -1).all()
    own, last = N.Scan([centres, centres + 1, centres], exact=True).assign(x, *state)
    assert last == 500 and (own == ((x - centres[state[0]]) ** 2).sum(axis=1)).all()
