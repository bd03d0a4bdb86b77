"""Helpers shared by the training-data operators.

Text work runs in Arrow batches: the UTF-8 bytes of a batch are one numpy array, word
spans and word hashes are computed over it without a Python object per word. Batches are
cut into slices of at most ``SLICE_BYTES`` (a longer document is a slice of its own), so
memory does not depend on how Spark sizes its batches.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from detlens.session import materialize

#: Bytes of text that are worked on at once.
SLICE_BYTES = 2 << 20
#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 4 << 20

#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Spark pattern of a space-separated word.
SPACED_PATTERN = "[^\\x20\\x09-\\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MUL = 0x9E3779B97F4A7C15
#: Pieces of 8 bytes that are hashed at once; masks that leave the first 0 to 8 bytes of one.
PIECES = 1 << 19
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """The texts of one slice as bytes: text i is ``data[lo[i]:hi[i]]``; null reads as empty."""

    def __init__(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.data, self.lo, self.hi = data, lo, hi

    def __len__(self) -> int:
        return len(self.lo)

    def raw(self, i: int) -> bytes:
        return self.data[self.lo[i]: self.hi[i]].tobytes()


class Words:
    """Word spans of a slice: word j is ``data[start[j]:end[j]]`` in text ``doc[j]``;
    the words of text i are ``first[i]:first[i + 1]``."""

    def __init__(self, texts: Texts, word_bytes: np.ndarray):
        data = texts.data
        n = len(data)
        inside = word_bytes[data]
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edge = texts.lo[(texts.lo < n) & (texts.lo < texts.hi)]
            opens[edge] |= inside[edge]
            last = texts.hi[(texts.hi > 0) & (texts.lo < texts.hi)] - 1
            closes[last] |= inside[last]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.append(np.searchsorted(self.start, texts.lo), len(self.start)).astype(np.int64)
        # Texts are consecutive in the buffer, so an empty text simply gets no words.
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Cut a string column into (first row, last row + 1, Texts) of at most ``limit`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, Texts(raw[off[a]: off[b]], off[a:b] - off[a], off[a + 1: b + 1] - off[a])
        a = b


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every span ``data[start:end]``: its 8-byte pieces are mixed apart, each with its
    place in the span, and then added up."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    # The 8 bytes from every position on, as a number.
    number = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    size = end - start
    total = np.empty(len(start), dtype=np.uint64)
    for a in range(0, len(start), PIECES):  # first pieces, the only ones of most words
        n = size[a: a + PIECES]
        total[a: a + PIECES] = mix((number[start[a: a + PIECES]].view("<u8").ravel() & _TAIL[np.minimum(n, 8)]) + np.uint64(_MUL))
    long = np.flatnonzero(size > 8)
    more = -(-size[long] // 8) - 1
    done = np.cumsum(more)
    a = 0
    while a < len(long):  # the others, some at a time
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PIECES, side="right")))
        n, at = more[a:b], long[a:b]
        first = np.cumsum(n) - n
        nth = np.arange(1, n.sum() + 1) - np.repeat(first, n)
        value = number[np.repeat(start[at], n) + 8 * nth].view("<u8").ravel()
        value &= _TAIL[np.minimum(np.repeat(size[at], n) - 8 * nth, 8)]
        total[at] += np.add.reduceat(mix(value + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(_MUL)), first)
        a = b
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of k consecutive words of one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0xA0761D6478BD642F)
        h += words[i: i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(h[at]), at


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker serves later tasks, too, with what it has taken."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read back, with its number of rows."""
    out = materialize(df, name)
    return out, out.count()


def with_key(rows: DataFrame, others: str) -> StructType:
    """The schema of ``rows``' key and the other columns; the key may be a struct of any columns."""
    return StructType([rows.schema["key"], *StructType.fromDDL(others)])


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """(key, text): whole rows as key, so that an operator's result can be unpacked to the rows."""
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("key"), F.col(text).alias("text"))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Ask for a broadcast only if the counted rows are few enough; else Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Every round each node takes the smallest label of its neighbourhood and then the label
    of its label, so long chains halve. Labels are written to the shared folder after every
    round. An edge has two rows, so a hot node is two join keys that AQE can split; minima are
    pre-aggregated before the shuffle.
    """
    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy(both["u"].alias("node"))
                .agg(F.min("component").alias("m")))
        step = (labels.join(near, "node", "left")
                .select("node", "component", F.least("component", "m").alias("m")))
        step = materialize(step, "labels")
        hop = step.select(F.col("node").alias("at"), F.col("m").alias("hop"))
        new = materialize(
            step.join(hop, step["m"] == hop["at"], "left")
            .select("node", "component", F.least("m", F.coalesce("hop", "m")).alias("new")), "labels")
        changed = not new.filter(F.col("new") != F.col("component")).isEmpty()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
