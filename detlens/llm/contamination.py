"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark's windows (13 words, or a whole shorter item) are the patterns. For every
pattern length a block of two words indexes a shift table: how far the search may move on
without passing a window's end. Where the shift is 0 the block's suffix bucket holds the
test windows, those with the same first block are taken, and their words are compared byte by byte. Documents are searched in pieces
that advance in step, so numpy moves thousands of cursors at once.

Patterns are dealt into blocks of about ``BLOCK_WORDS`` words. Each block is one broadcast
of bounded size and one pass over the documents; a benchmark of any size is searched whole.

Cases: null or empty texts have no words and no hits; an item without words has no window;
repeated items count once by item_id, and an item whose id is null counts as the id ''.
Repeated documents are separate rows. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.session import materialize

WINDOW = 13
#: Words of benchmark text in one broadcast block, on average.
BLOCK_WORDS = 200_000
#: An item is cut into pieces of so many words (overlapping by a window less one word).
PIECE_WORDS = 1024
#: Window ends that one cursor walks through.
CURSOR_ENDS = 512
#: Stretches and test windows that are compared at once.
COMPARED = 1 << 16
_A = np.uint64(0x9FB21C651E98DF25)


class _Length:
    """Tables for the windows of one length: shifts by block, and the test windows in buckets by their suffix block, in a
    bucket by a hash of their first block."""

    def __init__(self, length: int, at: np.ndarray, item: np.ndarray, hashes: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.buckets, bucket = np.unique(self._blocks(hashes, at + length - 1), return_inverse=True)
        places = self._places(bucket, self._blocks(hashes, at + self.block - 1))
        order = np.argsort(places, kind="stable")
        self.places, self.at, self.item = places[order], at[order], item[order]
        bits = max(10, int(np.ceil(np.log2(len(at) * length + 1))) + 3)
        self.mask = np.uint64((1 << bits) - 1)
        farthest = length - self.block + 1
        self.shift = np.full(1 << bits, farthest, dtype=np.int16)
        for i in range(farthest):  # a block whose last word is word i + block - 1 of the window
            b = self._blocks(hashes, at + i + self.block - 1)
            np.minimum.at(self.shift, (b & self.mask).astype(np.int64), farthest - 1 - i)

    @staticmethod
    def _places(bucket: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Numbers that sort by bucket, and in a bucket by half of the first block's hash."""
        return (bucket.astype(np.uint64) << np.uint64(32)) | (prefix >> np.uint64(32))

    def _blocks(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        return C.mix(hashes[last] if self.block == 1 else hashes[last - 1] * _A + hashes[last])

    def candidates(self, hashes: np.ndarray, words: C.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first words of stretches, numbers of the test windows to compare them with): where the search stops, the
        stretch's last block selects a bucket, and its first block the windows in it."""
        lo = words.first[:-1] + self.length - 1
        ends = words.first[:-1] + words.count
        pieces = np.maximum(0, -(-(ends - lo) // CURSOR_ENDS))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        p = np.repeat(lo, pieces) + nth * CURSOR_ENDS
        stop = np.minimum(p + CURSOR_ENDS, np.repeat(ends, pieces))
        none = np.zeros(0, dtype=np.int64)
        found = [(none, none)]
        while len(p):
            b = self._blocks(hashes, p)
            s = self.shift[(b & self.mask).astype(np.int64)]
            zero = s == 0
            if zero.any():
                q, b = p[zero], b[zero]
                bucket = np.minimum(np.searchsorted(self.buckets, b), len(self.buckets) - 1)
                some = self.buckets[bucket] == b
                first = q[some] - self.length + 1
                place = self._places(bucket[some], self._blocks(hashes, first + self.block - 1))
                lo, hi = np.searchsorted(self.places, place, "left"), np.searchsorted(self.places, place, "right")
                many = hi - lo
                found.append((np.repeat(first, many), np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)))
            p = p + np.maximum(s, 1)
            keep = p < stop
            p, stop = p[keep], stop[keep]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Patterns:
    """The compiled windows of one block of benchmark pieces ``(item, text, whole)``."""

    def __init__(self, pieces: list[tuple[str, str, bool]], window: int = WINDOW):
        texts = next((t for _, _, t in C.slices(pa.array([p[1] for p in pieces], pa.string()), 1 << 62)), None)
        self.names = sorted({p[0] for p in pieces})
        number = {x: i for i, x in enumerate(self.names)}
        self.lengths: list[_Length] = []
        if texts is None:
            return
        w = C.Words(texts, C.ALNUM)
        self.data, self.start, self.end = C.LOWER[texts.data], w.start, w.end
        hashes = C.span_hashes(texts.data, w.start, w.end, lower=True)
        item = np.array([number[p[0]] for p in pieces])
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, n in enumerate(w.count):
            if n:
                length = min(int(n), window)
                at = np.arange(w.first[i], w.first[i] + n - length + 1)
                by.setdefault(length, []).append((at, np.full(len(at), item[i])))
        for length, parts in sorted(by.items()):
            self.lengths.append(_Length(length, *(np.concatenate(x) for x in zip(*parts, strict=True)), hashes))

    def _same(self, texts: C.Texts, words: C.Words, a: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` words from a equal the pattern's words from q, byte by byte."""
        i, j = a[:, None] + np.arange(length), q[:, None] + np.arange(length)
        n = words.end[i] - words.start[i]
        same = (n == self.end[j] - self.start[j]).all(axis=1)
        rows = np.flatnonzero(same)
        if len(rows):
            i, j, n = i[rows].ravel(), j[rows].ravel(), n[rows]
            size, flat = n.sum(axis=1), n.ravel()
            within = np.arange(flat.sum()) - np.repeat(np.cumsum(flat) - flat, flat)
            differ = (C.LOWER[texts.data[np.repeat(words.start[i], flat) + within]]
                      != self.data[np.repeat(self.start[j], flat) + within])
            same[rows] = np.add.reduceat(differ.astype(np.int64), np.cumsum(size) - size) == 0
        return same

    def search(self, texts: C.Texts, words: C.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, item number) of every occurrence, item by item."""
        out = []
        for x in self.lengths:
            a, q = x.candidates(hashes, words)
            for k in range(0, len(a), COMPARED):
                a_k, q_k = a[k: k + COMPARED], q[k: k + COMPARED]
                good = self._same(texts, words, a_k, x.at[q_k], x.length)
                out.append((a_k[good], a_k[good] + x.length, x.item[q_k[good]]))
        if not out:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, words) with at most ``PIECE_WORDS`` normalised words a row; every window of an
    item lies in one of its pieces."""
    step = PIECE_WORDS - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids, counts, texts_out = [], [], []
            for a, _, texts in C.slices(batch.column(1)):
                w = C.Words(texts, C.ALNUM)
                for i in range(len(texts)):
                    at = range(w.first[i], w.first[i] + w.count[i])
                    all_words = [C.LOWER[texts.data[w.start[j]: w.end[j]]].tobytes().decode("utf-8", "replace") for j in at]
                    k = 0
                    while all_words and (k == 0 or k + window - 1 < len(all_words)):
                        part = all_words[k: k + PIECE_WORDS]
                        ids.append(names[a + i])
                        counts.append(len(part))
                        texts_out.append(" ".join(part))
                        k += step
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(counts, pa.int64()), pa.array(texts_out, pa.string())],
                names=["item", "n", "words"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, n long, words string")


_FOUND = "n_words long, hits array<int>, items array<string>"


def _pass(found: DataFrame, spark: SparkSession, patterns: Patterns) -> DataFrame:
    """One pass: add one block's hits (word ranges lo, hi, lo, hi, ...) and items to each document."""
    shared = spark.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = shared.value
        for batch in batches:
            n_words, hits, items = [], [], []
            old_hits, old_items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b, texts in C.slices(batch.column(1)):
                words = C.Words(texts, C.ALNUM)
                hashes = C.span_hashes(texts.data, words.start, words.end, lower=True)
                n_words.append(words.count)
                lo, hi, item = compiled.search(texts, words, hashes)
                new_hits, new_items = {}, {}
                for i in range(a, b):
                    if old_hits[i]:
                        new_hits[i - a], new_items[i - a] = [np.array(old_hits[i]).reshape(-1, 2)], set(old_items[i])
                if len(lo):
                    doc = words.doc[lo]
                    order = np.argsort(doc, kind="stable")
                    cuts = np.flatnonzero(np.diff(doc[order])) + 1
                    for part in np.split(order, cuts):
                        d = int(doc[part[0]])
                        spans = np.stack([lo[part], hi[part]], axis=1) - words.first[d]
                        new_hits.setdefault(d, []).append(spans)
                        new_items.setdefault(d, set()).update(compiled.names[x] for x in np.unique(item[part]))
                for d in range(b - a):
                    hits.append(_merge(np.concatenate(new_hits[d])) if d in new_hits else [])
                    items.append(sorted(new_items.get(d, ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                 pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["key", "text", "n_words", "hits", "items"])
        C.release_memory()  # the worker lives on

    return (found.select("key", "text", "hits", "items")
            .mapInArrow(run, C.with_key(found, f"text string, {_FOUND}")))


def _merge(spans: np.ndarray) -> list[int]:
    """Union of the ranges, flattened."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > top[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], top[last]], axis=1).ravel().tolist()


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, hits, items) for every document: ``hits`` are merged word ranges
    [lo, hi), flattened, and ``items`` the ids of the items with an occurring window."""
    spark = docs.sparkSession
    cut = materialize(pieces(benchmark, item, item_text, window), "patterns").distinct()
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    none = F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items")
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *none)
    for b in range(blocks):
        rows = dealt.filter(F.col("block") == b).select("item", "words").collect()  # about block_words words
        found = _pass(found, spark, Patterns([(r["item"], r["words"], True) for r in rows], window))
        if b + 1 < blocks:
            found = materialize(found, "contamination")
    return found.select(F.col("key").alias(key), "n_words", "hits", "items")


def decide(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and ``contaminated`` (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), F.lit(0).cast("long"),
        lambda s, i: s + F.get("hits", i + 1) - F.get("hits", i))
    return (found
            .withColumn("n_hit", F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(n_hit))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("items")), 256))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return decide(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
