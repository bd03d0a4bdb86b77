"""Prefix trie of conversations: ternary search trees per range shard, merged at shard boundaries.

A conversation is the list of its turns' digests; texts don't travel. Conversations are sorted by
that list and their id over range shards, so a node (a distinct list of first turns) lies in one
shard or in neighbouring ones, where it is a prefix of the last list of one and of the first list of
the next. Equal conversations may span many shards, too.

In a shard turns are dictionary-encoded (the ranks of their digests), equal lists are one list with a
count, and a ternary search tree takes the lists by median insertion, the middle one of a range
before its halves, which keeps the trees of siblings balanced. Nodes are numbered as they are made,
parents first; one loop in the opposite order, without recursion, adds up members, children,
leaves and savings, another one hands the parents' smallest members down.

Merging: a node that is a prefix of its shard's first or last list is summed by key over shards. Two
neighbouring shards both count the nodes that they share, so for each pair one row for each shared
node takes back the second count: of a child, of bytes that are stored once, and of a leaf if the
earlier shard ends with that very list. These rows follow from the shards' first and last lists.

``ends_sha256`` hashes ids in numeric order. Members of one node that span shards are passed on as
pieces of text, sorted and hashed in a stream, so no list of members is held as a whole.

Cases: null role or text is empty; rows without a conversation id belong to no conversation and are
left out; turns sort with null first, ties by digest; repeated rows are turns of their own; a
conversation without turns is a member of the root; no conversations give no nodes. A
conversation's turns (24 bytes each) must fit into a task, its texts need not. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.llm.sharding import crc32_sql
from detlens.session import materialize

#: Turns and conversations of a shard, about.
SHARD_SIZE = 500_000
#: Bytes of a piece of a node's members.
PIECE = 1 << 14
#: Rows of an output batch.
ROWS = 1 << 13
#: Conversations of a family take their first turns from the family's first one.
FAMILY = 5
MOST_HEAD = 8

EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")
_SHARD = (_NODE + ", shard int, nth int, piece binary, first_ids array<binary>, first_sizes array<long>, "
          "last_ids array<binary>, last_sizes array<long>")
_FIELDS = [("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
           ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
           ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("shard", pa.int32()), ("nth", pa.int32()),
           ("piece", pa.binary()), ("first_ids", pa.list_(pa.binary())), ("first_sizes", pa.list_(pa.int64())),
           ("last_ids", pa.list_(pa.binary())), ("last_sizes", pa.list_(pa.int64()))]
_SHARD_ARROW = pa.schema(_FIELDS)
_SHARED_ARROW = pa.schema([f for f in _FIELDS if f[0] in ("key", "n_children", "n_leaves", "saved_tokens")])
_ENDS_ARROW = pa.schema([("key", pa.binary()), ("ends", pa.string())])


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               family: Column | None = None) -> DataFrame:
    """(family, conv_id, turns): every conversation's turns in order, as (turn, id, size). A turn's id is a digest of
    role and text, its size the text's UTF-8 bytes. Rows are dealt by ``family``, a column over conv_id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    named = F.concat(F.octet_length(role).cast("string"), F.lit("/"), role, text)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("id"),
        F.octet_length(text).cast("long").alias("size")).alias("t")).filter(F.col("conv_id").isNotNull())
    rows = rows.withColumn("family", F.col("conv_id") if family is None else family).repartition("family")
    # The same partitioning serves this aggregate and any window over a family.
    return rows.groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the first h turns of the family's first conversation, then the own turns after the
    first h, where h is the CRC-32 of the id modulo 9."""
    lists = turn_lists(turns, family=F.col("conv_id") - F.col("conv_id") % FAMILY)
    head = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, MOST_HEAD)), ignorenulls=True)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")
    rows = lists.withColumn("head", head.over(Window.partitionBy("family"))).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    all_turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                         F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none))
    return rows.select("conv_id", all_turns.alias("turns")).select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


class TernarySearchTree:
    """Lists of numbers. Node 0 is the empty list; every other node ends a distinct list of first numbers: its number
    is ``turn[node]``, its list without that number ``parent[node]``. Parents have smaller node numbers."""

    def __init__(self):
        self.turn, self.low, self.equal, self.high, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def insert(self, numbers: list[int]) -> int:
        """Add a list and return its node. ``equal`` leads to the tree of the next numbers, ``low`` and ``high`` to
        smaller and larger ones."""
        turn, node = self.turn, 0
        for t in numbers:
            above, side, at = node, self.equal, self.equal[node]
            while at >= 0 and turn[at] != t:
                above, side = at, self.low if t < turn[at] else self.high
                at = side[at]
            if at < 0:
                at = len(turn)
                side[above] = at
                turn.append(t)
                for links in (self.low, self.equal, self.high):
                    links.append(-1)
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
            node = at
        return node

    def insert_sorted(self, lists: list[list[int]]) -> list[int]:
        """Add sorted distinct lists by median insertion; returns their nodes."""
        nodes, ranges = [0] * len(lists), [(0, len(lists))]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                m = (a + b) // 2
                nodes[m] = self.insert(lists[m])
                ranges += [(m + 1, b), (a, m)]
        return nodes


def node_key(above: bytes, turn: bytes) -> bytes:
    """The key of a node from its parent's key (empty for the root) and its turn's digest."""
    return hashlib.blake2b(above + turn, digest_size=16).digest()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row.get("piece") or b"")
        if len(part) >= ROWS or size >= ROWS * 64:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, whose rows (conv_id, ids, sizes, shard) come sorted by ids and conv_id."""
    lists, sizes, members, shard = [], {}, [], 0
    for batch in batches:
        for conv, ids, lengths, shard in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes", "shard"))):
            if not lists or ids != lists[-1]:
                lists.append(ids)
                members.append([])
                sizes.update(zip(ids, lengths))
            members[-1].append(conv)
    if lists:
        yield from _batches(_rows(lists, sizes, members, shard), _SHARD_ARROW)


def _rows(lists: list[list[bytes]], sizes: dict[bytes, int], members: list[list[int]], shard: int) -> Iterator[dict]:
    digests = sorted(sizes)
    rank = {digest: i for i, digest in enumerate(digests)}
    tree = TernarySearchTree()
    ends = tree.insert_sorted([[rank[t] for t in ids] for ids in lists])
    n = len(tree.turn)
    n_convs, n_children, n_leaves, saved, smallest, here = [0] * n, [0] * n, [0] * n, [0] * n, [None] * n, {}
    for node, ids in zip(ends, members):
        n_convs[node], smallest[node], here[node] = len(ids), ids[0], ids
    for node in range(n - 1, -1, -1):
        n_leaves[node] += not n_children[node]
        if node:
            saved[node] += (n_convs[node] - 1) * sizes[digests[tree.turn[node]]]
            above = tree.parent[node]
            n_convs[above] += n_convs[node]
            n_children[above] += 1
            n_leaves[above] += n_leaves[node]
            saved[above] += saved[node]
            if smallest[above] is None or smallest[node] < smallest[above]:
                smallest[above] = smallest[node]

    keys = {0: b""}  # of the nodes that other shards may share
    for node in (ends[0], ends[-1]):
        path = [node]
        while path[-1]:
            path.append(tree.parent[path[-1]])
        for above, below in zip(path[::-1], path[-2::-1]):
            keys.setdefault(below, node_key(keys[above], digests[tree.turn[below]]))
    for node in range(n):
        above = tree.parent[node]
        row = {"depth": tree.depth[node], "conv_id": smallest[node], "n_convs": n_convs[node], "n_children": n_children[node],
               "n_leaves": n_leaves[node], "saved_tokens": saved[node], "shard": shard}
        if node and above in keys:
            row["parent_key"] = keys[above]
        elif node:
            row["parent_conv_id"] = smallest[above]
        if node not in keys:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, here[node])).encode()).hexdigest() if node in here else EMPTY
            yield row
        else:
            yield row | {"key": keys[node]}
            text = ",".join(map(str, here.get(node, ()))).encode()
            for nth, a in enumerate(range(0, len(text), PIECE)):
                yield {"key": keys[node], "shard": shard, "nth": nth, "piece": text[a: a + PIECE]}
    yield {"shard": shard} | {f"{side}_{what}": values for side, ids in (("first", lists[0]), ("last", lists[-1]))
                              for what, values in (("ids", ids), ("sizes", [sizes[t] for t in ids]))}


def _counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For shards that are neighbours (ids, sizes of the earlier one's last list; next_ids of the later one's first):
    what to add to the sums of the nodes that they share."""

    def rows():
        for batch in batches:
            for ids, sizes, after in zip(*(batch.column(c).to_pylist() for c in ("last_ids", "last_sizes", "next_ids"))):
                shared = 0
                while shared < min(len(ids), len(after)) and ids[shared] == after[shared]:
                    shared += 1
                key, below = b"", sum(sizes[:shared])
                for depth in range(shared + 1):
                    if depth:
                        key = node_key(key, ids[depth - 1])
                        below -= sizes[depth - 2] if depth > 1 else 0
                    yield {"key": key, "n_children": -1 if depth < shared else 0, "n_leaves": -1 if shared == len(ids) else 0,
                           "saved_tokens": below}

    return _batches(rows(), _SHARED_ARROW)


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): the SHA-256 of every node's pieces, which come sorted by key, shard and number."""

    def rows():
        key, state = None, None
        for batch in batches:
            for k, nth, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "nth", "piece"))):
                if k != key:
                    if state:
                        yield {"key": key, "ends": state.hexdigest()}
                    key, state = k, hashlib.sha256()
                elif nth == 0:
                    state.update(b",")  # a further shard
                state.update(piece)
        if state:
            yield {"key": key, "ends": state.hexdigest()}

    return _batches(rows(), _ENDS_ARROW)


def trie(lists: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the conversations (conv_id, ids, sizes): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    lists = materialize(lists, "lists")
    if shards is None:
        turns = lists.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
        shards = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_SIZE))
    dealt = lists.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    made = materialize(dealt.sortWithinPartitions("ids", "conv_id").mapInArrow(_shard_nodes, _SHARD), "nodes")
    nodes = made.filter("depth IS NOT NULL")

    # A row for each shard; they meet in one task, but are no more than there are shards.
    pairs = (made.filter("first_ids IS NOT NULL")
             .select("last_ids", "last_sizes", F.lead("first_ids").over(Window.orderBy("shard")).alias("next_ids")).filter("next_ids IS NOT NULL"))
    twice = pairs.mapInArrow(_counted_twice, "key binary, n_children long, n_leaves long, saved_tokens long")
    pieces = made.filter("piece IS NOT NULL").select("key", "shard", "nth", "piece")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "nth").mapInArrow(_hashed_pieces, "key binary, ends string")
    sums = nodes.filter("key IS NOT NULL").unionByName(twice, allowMissingColumns=True).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    shared, n_shared = C.counted(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends"), "shared")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = shared.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv"))
    below = nodes.filter("key IS NULL AND parent_key IS NOT NULL").drop("parent_conv_id").select(*[c for c in columns if c != "parent_conv_id"], "parent_key")
    below = below.unionByName(shared.drop("key").filter("parent_key IS NOT NULL"))
    below = below.join(C.maybe_broadcast(parents, n_shared), F.col("parent_key") == F.col("_key")).withColumnRenamed("_conv", "parent_conv_id")
    return (nodes.filter("key IS NULL AND parent_key IS NULL").select(columns).unionByName(below.select(columns))
            .unionByName(shared.filter("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt conversations."""
    return trie(rebuilt(C.table(spark, sf_dir, "conversations")))


OP12_SQL = f"""
WITH r AS (
  SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, ''))) || '/' || coalesce(role, '') || coalesce(text, '')) AS id,
    octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL),
q AS (SELECT c, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, id) AS t FROM r GROUP BY c),
g AS (
  SELECT q.c, CAST({crc32_sql("encode(CAST(q.c AS VARCHAR))")} % 9 AS INT) AS h, q.t, coalesce(b.t, []) AS b
  FROM q LEFT JOIN q AS b ON b.c = q.c - q.c % 5),
s AS (SELECT c, list_concat(b[1:h], t[h + 1:]) AS t FROM g),
p AS (
  SELECT c, d, list_transform(t[1:d], lambda e: e.id) AS path, t[d].size AS size, d = len(t) AS ends
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM s)),
n AS (
  SELECT path, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(coalesce(size, 0)) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
a AS (
  SELECT path[1:a] AS path, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (path) LEFT JOIN f AS u ON f.d > 0 AND u.path = f.path[1:f.d - 1]
"""
