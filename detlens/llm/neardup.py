"""Near-duplicate components by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles. Equal sets are one class. The signature of a
class is ``COMPONENTS`` MinHash values cut to 16 bits; the distance of two signatures is the
number of components that differ. Signatures are split into ``CHUNKS`` chunks. If two of them
differ in at most ``DISTANCE`` components, then by pigeonhole some chunk differs in at most
``DISTANCE // CHUNKS`` of its components, so every way of leaving out that many components of
every chunk is an index key: all pairs within the distance share a key. Candidates within the
distance are confirmed on the full shingle sets.

With 20 components, 4 chunks and distance 11, a pair of similarity 0.8 exactly lies outside
the distance with probability 1e-4, one of 0.85 with 1e-5.

A key's members are compared with its smallest member only (pre-aggregated, a row per member).
The members of keys that are then still in different components are compared by an exact
filter: a shared shingle among the rarest of either set, and enough left after it; first with
the most typical set of each such shingle, then, where components still differ, with each other.
So a large group of near copies costs rows per member, not per pair, and no link is lost.

Cases: null, empty or blank texts have the empty set and are linked with nothing (also not
with each other); a text of fewer words than a shingle is one shingle; repeated rows belong to
the same class and each gets a result row; a null key sorts after all others and is never a
component's name unless the component has no other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.session import materialize

SHINGLE = 4
COMPONENTS = 20
CHUNKS = 4
DISTANCE = 11
SIMILARITY = (80, 100)
_WIDTH = COMPONENTS // CHUNKS
_OUT = DISTANCE // CHUNKS
_SIGNATURE = [f"s{i}" for i in range(COMPONENTS // 4)]
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: C.Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, count): text i has the shingles ``hashes[first[i]:first[i] + count[i]]``, with repeats."""
    w = C.Words(texts, C.SPACED)
    words = C.span_hashes(texts.data, w.start, w.end, lower=True)
    full, at = C.shingle_hashes(words, w.doc, k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            more = w.count[short] > j
            whole[more] = whole[more] * np.uint64(0xE7037ED1A0B428DB) + words[w.first[short[more]] + j]
        whole = C.mix(whole + w.count[short].astype(np.uint64))
        where = np.searchsorted(at, w.first[short])
        full = np.insert(full, where, whole)
    count = np.maximum(w.count - k + 1, (w.count > 0).astype(np.int64))
    return full, np.cumsum(count) - count, count


def _signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 64-bit words, four 16-bit components each, for every (non-empty) set."""
    out = np.empty((len(first), COMPONENTS), dtype=np.uint64)
    for i in range(COMPONENTS):
        x = (hashes ^ _XOR[i]) * _ODD[i]
        x ^= x >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(x, first)
    out = C.mix(out.ravel()).reshape(-1, COMPONENTS) & np.uint64(0xFFFF)
    packed = np.zeros((len(first), len(_SIGNATURE)), dtype=np.uint64)
    for i in range(COMPONENTS):
        packed[:, i // 4] |= out[:, i] << np.uint64(16 * (i % 4))
    return packed.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, set_id, n_shingles, s0 ...): set_id is a 128-bit digest of the sorted set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in C.slices(batch.column(1)):
                hashes, first, count = shingle_sets(texts, shingle)
                ids: list[bytes | None] = []
                sizes = np.zeros(len(texts), dtype=np.int64)
                for i in range(len(texts)):
                    if count[i]:
                        s = np.unique(hashes[first[i]: first[i] + count[i]])
                        sizes[i] = len(s)
                        ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    else:
                        ids.append(None)
                packed = np.zeros((len(texts), len(_SIGNATURE)), dtype=np.int64)
                full = np.flatnonzero(count)
                if len(full):
                    packed[full] = _signatures(hashes, first[full])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(sizes),
                     *(pa.array(packed[:, i]) for i in range(packed.shape[1]))],
                    names=["key", "text_hash", "set_id", "n_shingles", *_SIGNATURE])
        C.release_memory()  # the worker lives on

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, C.with_key(rows, "text_hash long, set_id binary, n_shingles long, " + ", ".join(f"{s} long" for s in _SIGNATURE)))


def _component(i: int) -> Column:
    return F.shiftrightunsigned(F.col(_SIGNATURE[i // 4]), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def _keys() -> Column:
    """All index keys of a signature: the components left in (48 bits) above the choice's number."""
    keys = []
    for chunk in range(CHUNKS):
        for kept in combinations(range(_WIDTH), _WIDTH - _OUT):
            parts = [F.shiftleft(_component(chunk * _WIDTH + j), 16 * n) for n, j in enumerate(kept)]
            keys.append(F.shiftleft(reduce(Column.bitwiseOR, parts), 6).bitwiseOR(F.lit(len(keys))))
    return F.explode(F.array(*keys))


def _distance(a: str, b: str) -> Column:
    """Components in which the signatures a.s0 ... and b.s0 ... differ."""
    return reduce(Column.__add__, (
        F.when(F.shiftrightunsigned(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")), 16 * j)
               .bitwiseAND(F.lit(0xFFFF)) == 0, 0).otherwise(1)
        for s in _SIGNATURE for j in range(4)))


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(node, full): the sorted shingle hashes of the classes named by ``nodes``, read again from one text each."""
    wanted, n = C.counted(nodes.join(classes.select("node", "set_id", F.col("first_key").alias("key"), "text_hash"), "node"), "wanted")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    # By the text, too: rows of one key, or without any, may have many texts.
    same = rows["doc"].eqNullSafe(wanted["key"]) & (rows["hash"] == wanted["text_hash"])
    texts = rows.join(C.maybe_broadcast(wanted, n), same).select("node", "set_id", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_pylist()
            for a, _, t in C.slices(batch.column(2)):
                hashes, first, count = shingle_sets(t, shingle)
                at, sets = [], []
                for i in range(len(t)):
                    s = np.unique(hashes[first[i]: first[i] + count[i]])
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want[a + i]:
                        at.append(a + i)
                        sets.append(s.view(np.int64))
                offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["node", "full"])
        C.release_memory()

    return materialize(texts.mapInArrow(full, "node long, full array<long>").groupBy("node").agg(F.first("full").alias("full")), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough."""
    num, den = similarity

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a")
            .select("a", "b", "fa", "fb").mapInArrow(exact, "a long, b long"))


def _prefixes(live: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(h, node, n, p): the first shingles of the sets in ``live`` (node, full), rare ones first; a
    shingle h at place p of n is listed if a similar set may have it as the first one in common.

    Similar sets share a shingle among their first |s| - ceil(similarity |s|) + 1 ones in any common
    order. Shingles that only one set has come first and need no row.
    """
    num, den = similarity
    tokens = live.select("node", F.size("full").alias("n"), F.explode("full").alias("h"))
    common = tokens.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1")
    node = Window.partitionBy("node")
    return (tokens.join(common, "h")
            .withColumn("p", F.col("n") - F.count("*").over(node) + F.row_number().over(node.orderBy("d", "h")) - 1)
            .filter(den * F.col("p") <= (den - num) * F.col("n")).select("h", "node", "n", "p"))


def _apart(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """The prefixes with labels, of those shingles whose sets have different labels."""
    named = (prefixes.join(labels, "node", "left").select("h", "node", "n", "p", F.coalesce("component", "node").alias("label")))
    mixed = (named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("p", "node", "n", "label")).alias("c"))
             .filter("lo < hi").select("h", "c"))
    return materialize(named.join(materialize(mixed, "mixed"), "h"), "apart")


def _possible(nx: Column, px: Column, ny: Column, py: Column, similarity: tuple[int, int]) -> Column:
    """Whether enough is left from the common shingle on for sets of nx and ny shingles to be similar."""
    num, den = similarity
    return (num + den) * F.least(nx - px, ny - py) >= num * (nx + ny)


def _to_center(apart: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Each set with the set that has the least of its own before a shared shingle: a row per prefix shingle."""
    pairs = apart.filter((F.col("label") != F.col("c.label")) & _possible(F.col("n"), F.col("p"), F.col("c.n"), F.col("c.p"), similarity))
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _to_each_other(apart: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All possible pairs of different labels."""
    rows = apart.select("h", "node", "n", "p", "label")
    x, y = rows.alias("x"), rows.alias("y")
    return (x.join(y, [F.col("x.h") == F.col("y.h"), F.col("x.label") != F.col("y.label"), F.col("x.node") < F.col("y.node"),
                       _possible(F.col("x.n"), F.col("x.p"), F.col("y.n"), F.col("y.p"), similarity)])
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                    similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every document; ``similarity`` is a fraction."""
    signed = materialize(signatures(docs, key, text, shingle), "signatures")
    least = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "text_hash"))
    classes = materialize(
        signed.filter(F.col("set_id").isNotNull()).groupBy("set_id")
        .agg(least.alias("least"), *(F.first(s).alias(s) for s in _SIGNATURE))
        .select("set_id", F.col("least.key").alias("first_key"), "least.text_hash", *_SIGNATURE)
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", _keys().alias("k"))
    shared, n_shared = C.counted(
        keys.groupBy("k").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"), "keys")
    members = materialize(keys.join(C.maybe_broadcast(shared, n_shared, 32), "k"), "members")

    sig = classes.select("node", *_SIGNATURE)
    star = members.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    near = materialize(star.join(sig.alias("x"), F.col("a") == F.col("x.node"))
                       .join(sig.alias("y"), F.col("b") == F.col("y.node"))
                       .filter(_distance("x", "y") <= DISTANCE).select("a", "b"), "pairs")
    sets = _full_sets(members.select("node").distinct(), classes, docs, key, text, shingle)
    links = materialize(_confirm(near, sets, similarity), "links")
    labels = C.components(links)

    # The members of keys that are still apart: whether any other pair of them is linked.
    placed = members.join(labels, "node", "left").select("k", "node", F.coalesce("component", "node").alias("label"))
    apart = (placed.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
             .filter("lo < hi and n > 2"))
    apart, n_apart = C.counted(apart.select("k"), "apart")
    if n_apart:
        live = placed.join(C.maybe_broadcast(apart, n_apart, 16), "k").select("node").distinct()
        prefixes = materialize(_prefixes(live.join(sets, "node"), similarity), "prefixes")
        tried = near
        for choose in (_to_center, _to_each_other):
            more = materialize(choose(_apart(prefixes, labels), similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
            links = materialize(links.unionByName(_confirm(more, sets, similarity)), "links")
            labels = C.components(links)
            tried = tried.unionByName(more)

    named = materialize(
        classes.select("node", "set_id", "first_key").join(labels, "node", "left")
        .select("set_id", "first_key", F.coalesce("component", "node").alias("label")), "named")
    least = materialize(named.groupBy("label").agg(F.min("first_key").alias("component_id")), "least")
    by_set = materialize(named.join(least, "label").select("set_id", "component_id"), "by-set")
    out = signed.select("key", "set_id", "n_shingles").join(by_set, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                      F.col("key").eqNullSafe(component).alias("kept"))


def op9_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component over lower-cased 4-word shingles at 0.8."""
    return near_duplicates(C.table(spark, sf_dir, "documents"), shingle=SHINGLE)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') || '|' || least(len(w), 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, documents.doc_id = m.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
