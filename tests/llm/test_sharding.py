import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from detlens.llm import sharding as S
from detlens.session import materialize


def winner(key, shards):
    def score(name, weight):
        text = f"{S.SEED}/{name}" + ("" if key is None else f"/{key}")
        return -math.log((int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight

    return min(range(len(shards)), key=lambda i: (score(*shards[i]), i))


def brute(rows, shards, grown):
    placed = defaultdict(list)
    for key, text in rows:
        data = (text or "").encode()
        placed[winner(key, shards)].append((key, len(data) + 1, zlib.crc32(data), winner(key, shards + (grown,))))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return sorted(((k, size, crc, s, slot, g) for s, members in placed.items()
                   for slot, (k, size, crc, g) in enumerate(sorted(members, key=order))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(5) + "x" * rng.randrange(60)) for i in range(900)]
    # A key that a third of all rows share, with equal and with other texts; rows without a key.
    rows += [(7, "same")] * 300 + [(7, f"other {i}") for i in range(150)] + [(None, "no key")] * 40 + [(None, None), (3, None), (3, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("weights", [(1, 1, 1, 1, 1, 1, 1, 1), (1, 2, 0.5)])
def test_equals_brute_force(spark, rows, weights):
    shards = tuple((f"s{i}", float(w)) for i, w in enumerate(weights))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.place(df, shards, ("new", 1.5))) == brute(rows, shards, ("new", 1.5))


def test_shares_follow_weights_and_few_rows_move(spark):
    shards = (("a", 1.0), ("b", 2.0), ("c", 3.0))
    df = spark.range(24000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = S.place(df, shards, ("d", 2.0)).select("shard", "grown_shard").collect()
    share = Counter(r.shard for r in rows)
    assert all(abs(share[i] / 24000 - w / 6) < 0.012 for i, w in enumerate((1, 2, 3)))
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / 24000 - 2 / 8) < 0.012


def test_order_of_shards_does_not_matter(spark):
    shards = tuple((f"s{i}", 1.0 + i % 3) for i in range(6))
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    name = lambda order: {r.doc_id: order[r.shard][0] for r in S.place(df, order, None).collect()}
    assert name(shards) == name(shards[::-1])


def test_a_hot_key_is_split_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(1, i % 2) for i in range(6000)], "g int, k int").repartition(4)
    ranges = []
    monkeypatch.setattr(S, "materialize", lambda df, name: ranges.append(materialize(df, name)) or ranges[-1])
    hot = materialize(df, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one partition
    try:
        out = S.numbered(hot, "g", "k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in ranges[0].groupBy("_range").count().collect()) < 2000
    assert sorted(r.slot for r in out) == list(range(6000))
    assert all(r.k == (r.slot >= 3000) for r in out)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = S.op13_rendezvous_shards(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_wrong_shards(spark, odd):
    for shards in ((), (("a", 1.0), ("a", 1.0)), (("a", 0.0),)):
        with pytest.raises(ValueError):
            S.place(odd, shards)


def test_odd_rows(spark, odd, odd_rows, nothing):
    assert got(S.place(odd)) == brute([(r[0], r[1]) for r in odd_rows], S.SHARDS, S.NEXT)
    assert S.place(nothing).collect() == []
