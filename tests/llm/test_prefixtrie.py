import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from detlens.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    first = lambda c: c - int(math.fmod(c, 5))  # noqa: E731  -4 % 5 is -4 in SQL
    return {c: own.get(first(c), [])[:head(c)] + ts[head(c):] for c, ts in own.items()}


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(p))))
        tree = list(below(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in tree),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in tree if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def plain(seqs):
    return [(c, i, role, text) for c, s in seqs.items() for i, (role, text) in enumerate(s)]


def lists(spark, seqs):
    """Conversations as they are, without the rebuilding."""
    df = spark.createDataFrame(plain(seqs), SCHEMA).repartition(3)
    return P.turn_lists(df).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


@pytest.fixture(scope="module")
def seqs():
    """Conversations over few turns, so that prefixes are shared; one that a third of all equal."""
    rng = random.Random(8)
    turn = lambda: (rng.choice(("user", "assistant")), "é" * rng.randrange(3) + rng.choice("abc"))
    seqs = {c: [turn() for _ in range(rng.randrange(1, 7))] for c in range(400)}
    hot = [("user", "hello"), ("assistant", "how may I help?"), ("user", "bye")]
    seqs |= {c: list(hot) for c in range(1000, 1250)}
    seqs |= {c: hot[:2] + [turn() for _ in range(rng.randrange(3))] for c in range(1250, 1300)}
    seqs[2000] = [("user", f"turn {i}") for i in range(300)]
    seqs[2001] = seqs[2000][:250] + [("user", "other")]
    return seqs


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_any_number_of_shards_equals_brute_force(spark, seqs, shards):
    assert got(P.trie(lists(spark, seqs), shards)) == brute(seqs)


def test_rebuilt_conversations_equal_brute_force(spark, seqs):
    rows = plain(seqs) + [(3, 99, None, None), (7, None, "user", "first"), (7, 99, "user", "tie"), (7, 99, "user", "tie"), (None, 0, "user", "nobody"),
                          (None, None, None, None), (-4, 0, "user", "x"), (5004, 0, "user", "its first conversation is absent")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("key", "ids", "sizes", "shard", "turns", "family", "h"))))
    assert got(P.trie(P.rebuilt(df))) == brute(sequences(rows))


def test_conversations_without_turns_are_members_of_the_root(spark):
    none = next(c for c in range(5001, 9000, 5) if zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(none, 0, "user", "gone"), (none + 20000, 0, "user", "x" * 50)]
    assert got(P.trie(P.rebuilt(spark.createDataFrame(rows, SCHEMA)), 3)) == brute(sequences(rows))


def test_no_conversations(spark):
    assert got(P.trie(P.rebuilt(spark.createDataFrame([], SCHEMA)))) == []
    assert got(P.trie(P.rebuilt(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)))) == []


def test_very_long_texts(spark):
    text = "long é " * 300_000
    rows = [(c, t, "user", f"{text}{t // 2}") for c in (10, 15, 20) for t in range(3)]
    assert got(P.trie(P.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(sequences(rows))


def test_median_insertion_keeps_siblings_balanced():
    tree = P.TernarySearchTree()
    nodes = tree.insert_sorted([[i] for i in range(1023)])
    assert sorted(nodes) == list(range(1, 1024)) and [tree.turn[n] for n in nodes] == list(range(1023))

    height, level = 0, [tree.equal[0]]
    while level:
        height, level = height + 1, [x for n in level for x in (tree.low[n], tree.high[n]) if x >= 0]
    assert height == 10


def test_members_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    ids = list(range(5, 1000, 3))
    lists = [[b"a" * 16]]
    rows = [r for shard, part in enumerate((ids[:100], ids[100:101], ids[101:])) for r in P._rows(lists, {b"a" * 16: 1}, [part], shard) if "piece" in r]
    assert len(rows) > 100
    batch = pa.RecordBatch.from_pylist(rows, P._SHARD_ARROW)
    out = [r for b in P._hashed_pieces(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
    assert [r["ends"] for r in out] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
