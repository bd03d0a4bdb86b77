import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from detlens.llm import mixing as M


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    sizes = {"a": 400, "B": 30, "b": 5, "é": 60, "\U0001f600": 3, None: 20}
    out, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((i, " ".join(["w"] * rng.randrange(0, 80)) or None, source))
            i += 1
    return out


def water(sizes):
    """Targets by resharing one source at a time."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        level = (total - sum(full.values())) / sum(weight[s] for s in sizes if s not in full)
        over = [s for s in sizes if s not in full and weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in sizes}
        full |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_sums(spark, rows):
    got = M.mix(table(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len((rows[r.doc_id][1] or "").split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:  # the running sum stops within half a document
        assert abs(taken[s] - want[s]) <= 40, s
        copies = [r.copies for r in got if r.source == s and r.size]
        assert max(copies) - min(copies) <= 1  # whole epochs come first


def test_sample_is_the_sorted_prefix(spark, rows):
    """Against one sort per source: ranges and prefix sums choose what the whole order would."""
    got = {r.doc_id: r for r in M.mix(table(spark, rows)).collect()}
    import hashlib
    draw = lambda i: -math.log((int(hashlib.md5(f"{M.SEED}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / M.UNKNOWN
    for s in {r[2] for r in rows}:
        ids = sorted((i for i, _, x in rows if x == s), key=draw)
        run, first = 0, got[ids[0]]
        epochs = int(first.target // first.source_size)
        for i in ids:
            run += got[i].size
            assert got[i].copies == epochs + (run - got[i].size / 2 < first.target - epochs * first.source_size)


def test_reruns_and_partitions_agree(spark, rows):
    a = M.mix(table(spark, rows)).select("doc_id", "copies")
    b = M.mix(table(spark, rows[::-1]).repartition(7)).select("doc_id", "copies")
    assert sorted(a.collect()) == sorted(b.collect())


def test_quality_raises_the_chance(spark):
    df = table(spark, [(i, "w " * 10, "s" if i < 4000 else "t") for i in range(12000)])
    good = spark.range(0, 12000, 2).select(F.col("id").alias("key"), F.lit(2.0).alias("quality"))
    poor = spark.range(1, 12000, 2).select(F.col("id").alias("key"), F.lit(1.0).alias("quality"))
    got = M.mix(df, good.unionByName(poor), weights=(1, 1)).filter("source = 't'").groupBy(F.col("doc_id") % 2).sum("copies").collect()
    n = dict(map(tuple, got))
    assert n[0] > 1.2 * n[1]


def test_ordinal(spark):
    df = spark.createDataFrame([(random.Random(i).randrange(50),) for i in range(300)] + [(None,)], "x int").repartition(5)
    got = [r.x for r in M.ordinal(df, F.col("x").asc_nulls_last()).orderBy("ordinal").collect()]
    assert got == sorted(got[:-1]) + [None]


def test_odd_rows(spark, odd, nothing):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)
    assert M.mix(nothing).collect() == []
    blank = M.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert all((r.target, r.taken) == (0.0, 0) for r in blank)
