"""Token-id files: canonical length-limited Huffman codes, blocks with bit-offset checkpoints.

1. Documents are put in order (range partitioning by key) and tokenised once; a document's ids,
   each followed by the end id, are kept as a table.
2. Ids are counted over all documents; the counts (at most one row per vocabulary entry) give
   the code lengths by package-merge, and the lengths alone define the canonical codes.
3. Every shard of consecutive documents becomes a file: header, code lengths, document table,
   checkpoints, code bits. Ids are dealt into blocks of ``BLOCK_IDS``; the checkpoint of a
   block is the bit at which it starts, so blocks are decoded independently.
4. The reader decodes all blocks of a file in step: one table look-up gives the id and its length.

Files have names of their own for every task attempt and count only if the manifest, which Spark
writes, names them.

Tokenising: the tokenizer splits a text before it merges, and a single space between two visible
characters always begins a new piece. So a text is cut there, equal pieces of a batch are encoded
once, and the ids are put together again; the result is that of encoding the whole text. A text that
holds one of the tokenizer's added tokens (such as its end-of-text string) is encoded in one piece.

Cases: a null or empty text is the end id alone; a null key comes first in order; rows with
equal keys follow each other in the order of their texts' hashes.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.llm.warc import open_folder
from detlens.session import materialize, shared_path

END_ID = 0
BLOCK_IDS = 256
MAX_BITS = 20
_STEP = BLOCK_IDS * 512
#: Ids in one file, about.
SHARD_IDS = 8 << 20
#: Pieces whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 1_500_000
#: Longer pieces are encoded without being remembered.
PIECE_BYTES = 64
#: Bytes of text that are cut at once (a longer text is cut alone), texts that the tokenizer is given at once, and ids
#: that are decoded at once: what a Python worker holds on top of the remembered pieces.
CUT_BYTES = 1 << 20
ENCODED = 1 << 12
DECODED_IDS = 1 << 19
MAGIC = b"HUFTOK01"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_HEAD = struct.Struct("<8sIIQQQ")  # magic, vocabulary, ids a block, documents, ids, bits


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer's file, from its installed package or from the folder that holds it."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        sys.path.append("/opt")
        import public_tokenizers
    return public_tokenizers.path(name)


# --- tokenising -----------------------------------------------------------------------------


def _cuts(texts: C.Texts, added: re.Pattern | None = None) -> np.ndarray:
    """Where a piece starts (a text that holds a token of the tokenizer's added ones is one piece): at texts' starts, at a single space between visible characters, after
    a single newline between them, and at ASCII punctuation that follows a letter. Visible here:
    printable ASCII, or U+00C0 to U+027F; letters are those of these ranges."""
    d = texts.data
    n = len(d)
    visible = (d > 0x20) & (d < 0x7F)
    lead = (d >= 0xC3) & (d <= 0xC9)
    tail = np.zeros(n, dtype=bool)
    tail[1:] = lead[:-1] & (d[1:] >= 0x80)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        single = (visible | tail)[:-2] & (visible | lead)[2:]
        cut[1:n - 1] |= single & (d[1:-1] == 0x20)
        cut[2:n] |= single & (d[1:-1] == 0x0A)
    if n > 1:
        sign = tail & ((d == 0x97) | (d == 0xB7))
        sign[1:] &= d[:-1] == 0xC3  # the signs for times and divided by
        letter = _LETTER[d] | (tail & ~sign)
        cut[1:n] |= letter[:-1] & visible[1:] & ~_LETTER[d[1:]] & ~_DIGIT[d[1:]]
    if added:
        found = np.fromiter((m.start() for m in added.finditer(d.tobytes())), dtype=np.int64)
        for i in np.unique(np.searchsorted(texts.lo, found, side="right") - 1):
            cut[texts.lo[i]: texts.hi[i]] = False
    cut[texts.lo] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Encodes slices of texts piece by piece and remembers the pieces' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, dtype=np.uint64)  # sorted hashes of pieces, and where their ids are
        self.first, self.count = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)  # a byte has an id at most
        self.ids = np.zeros(0, dtype=np.uint16)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts that the tokenizer encodes one by one."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids, count = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(texts), ENCODED):
            some = [e.ids for e in encode(texts[k: k + ENCODED], add_special_tokens=False)]
            count.append(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
            ids.append(np.fromiter(chain.from_iterable(some), dtype=np.uint16, count=int(count[-1].sum())))
        return np.concatenate(ids), np.concatenate(count)

    def _learn(self, texts: C.Texts, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = texts.data.tobytes()
        ids, count = self._whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        order = np.argsort(hashes)
        first = (len(self.ids) + np.cumsum(count) - count)[order]
        at = np.searchsorted(self.seen, hashes[order])
        self.seen = np.insert(self.seen, at, hashes[order])
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count[order])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: C.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a slice, without end ids."""
        if not len(texts.data):
            return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
        start = _cuts(texts, self.added)
        end = np.append(start[1:], len(texts.data))
        hashes = C.span_hashes(texts.data, start, end)
        long = np.flatnonzero(end - start > PIECE_BYTES)
        codes, unique = pd.factorize(hashes)
        where = np.empty(len(unique), dtype=np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        short = end[where] - start[where] <= PIECE_BYTES
        if len(self.seen) + len(unique) > REMEMBERED:
            self._forget()
        fresh = np.flatnonzero(short & ~self._known(unique))
        if len(fresh):
            self._learn(texts, unique[fresh], start[where[fresh]], end[where[fresh]])
        slot = np.minimum(np.searchsorted(self.seen, unique), max(0, len(self.seen) - 1))[codes]
        if not len(self.seen):
            first, count, pool = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64), self.ids
        else:
            first, count, pool = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64), self.ids
        if len(long):
            ids, sizes = self._whole([texts.data[start[i]: end[i]].tobytes().decode("utf-8", "replace") for i in long])
            first[long], count[long] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, ids])
        ids = pool[_ramp(first, count)]
        run = np.append(0, np.cumsum(count))
        return ids, run[np.searchsorted(start, texts.hi)] - run[np.searchsorted(start, texts.lo)]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.zeros(len(hashes), dtype=bool)
        return self.seen[np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)] == hashes


def _ramp(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + count, count)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _planes(ids: np.ndarray) -> bytes:
    """Low bytes, then high bytes: compresses better than pairs."""
    return (ids & 0xFF).astype(np.uint8).tobytes() + (ids >> 8).astype(np.uint8).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).reshape(2, -1)
    return b[0] | (b[1].astype(np.uint16) << 8)


def tokenise(docs: DataFrame, path: str, key: str, text: str, end_id: int = END_ID) -> DataFrame:
    """(key, part, before, n, ids): documents in order within ``part``, ``before`` ids earlier in it."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = (rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
            .sortWithinPartitions("part", *order).select("key", "part", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before, part = encoder(path), 0, None
        for nth, batch in enumerate(batches):
            if nth % 4 == 3:
                C.release_memory()
            parts = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, texts in C.slices(batch.column(2), CUT_BYTES):
                ids, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                n, starts, data = counts + 1, [], []
                for i in range(b - a):
                    if parts[a + i] != part:
                        part, before = parts[a + i], 0
                    starts.append(before)
                    before += int(n[i])
                    data.append(_planes(np.append(ids[ends[i] - counts[i]: ends[i]], np.uint16(end_id))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(starts, pa.int64()),
                     pa.array(n), pa.array(data, pa.binary())], names=["key", "part", "before", "n", "ids"])
        C.release_memory()  # the worker lives on

    return rows.mapInArrow(run, "key long, part int, before long, n long, ids binary")


# --- codes ----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the symbols with a count (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    levels, packed = [], np.zeros(0)
    for _ in range(max_bits):  # each level merges the symbols with the pairs of the level before
        both = np.concatenate([weights, packed])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        even = len(both) // 2 * 2
        packed = both[0:even:2] + both[1:even:2]
    depth = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_symbol in reversed(levels):  # of the first ``take`` entries: symbols get a bit, pairs open two below
        symbols = int(is_symbol[:take].sum())
        depth[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for bits in np.unique(lengths[order]):
        group = order[lengths[order] == bits]
        code <<= int(bits) - last
        codes[group] = code + np.arange(len(group))
        code, last = code + len(group), int(bits)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length, bits): by the next ``bits`` bits of the stream."""
    bits = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbol, length = np.repeat(order, spans), np.repeat(lengths[order], spans)
    fill = (1 << bits) - len(symbol)
    return np.append(symbol, np.zeros(fill, dtype=symbol.dtype)).astype(np.uint32), np.append(length, np.ones(fill, np.uint8)).astype(np.uint8), bits


# --- files ----------------------------------------------------------------------------------


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, int]:
    """(checkpoints, bytes, bits): the ids' codes one after another, high bits first."""
    codes = codes.astype(np.uint64)
    marks, bits = [], 0
    words = np.zeros(int(lengths[ids].sum(dtype=np.int64)) // 32 + 3, dtype=np.uint64)
    step = max(1, _STEP // block) * block
    for k in range(0, len(ids), step):  # a whole number of blocks, small enough for the processor's cache
        part = ids[k: k + step]
        n = lengths[part].astype(np.int64)
        starts = np.cumsum(n) - n + bits
        marks.append(starts[::block])
        bits = int(starts[-1] + n[-1])
        # A code of up to 32 bits lies within 64 bits from its 32-bit word on.
        at = starts >> 5
        value = codes[part] << (64 - (starts & 31) - n).astype(np.uint64)
        # Codes that begin in one 32-bit word share no bits.
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        union = np.bitwise_or.reduceat(value, first)
        words[at[first]] |= union >> np.uint64(32)
        words[at[first] + 1] |= union & np.uint64(0xFFFFFFFF)
    data = words.astype(">u4").view(np.uint8)[: (bits + 7) // 8]
    return np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64), data, bits


def unpack(data: np.ndarray, checkpoints: np.ndarray, total: int, lengths: np.ndarray, block: int,
           which: slice = slice(None)) -> np.ndarray:
    """The ids of the chosen blocks; every block is decoded from its own checkpoint, all in step."""
    symbol, length, bits = decode_table(lengths)
    blocks = np.arange(len(checkpoints))[which]
    if not len(blocks):
        return np.zeros(0, dtype=np.uint32)
    # From the byte in which the first block starts to that in which the block after the last does.
    low, after = int(checkpoints[blocks[0]]) >> 3, int(blocks[-1]) + 1
    high = (int(checkpoints[after]) >> 3) + 1 if after < len(checkpoints) else len(data)
    padded = np.concatenate([data[low:high], np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    # The 32 bits from every byte on: a look-up needs at most bits + 7 <= 32 of them.
    view = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    pos = checkpoints[blocks].astype(np.int64) - 8 * low
    left = np.minimum(block, total - blocks * block)
    out = np.zeros((len(blocks), block), dtype=np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for i in range(block):
        if len(left) and left[-1] <= i:  # only the last block may be shorter
            last = np.searchsorted(-left, -i, side="left")
            pos, left = pos[:last], left[:last]
        if not len(pos):
            break
        peek = (view[pos >> 3] >> (32 - bits - (pos & 7)).astype(np.uint32)) & mask
        out[: len(pos), i] = symbol[peek]
        pos += length[peek]
    keep = np.minimum(block, total - blocks * block)
    return out[np.arange(block) < keep[:, None]]


def shard_bytes(keys: list[int | None], starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray,
                codes: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A file: header, packed code lengths, document table, checkpoints, code bits, CRC-32 of all before."""
    checkpoints, data, bits = pack(ids, lengths, codes, block)
    table = zlib.compress(lengths.astype(np.uint8).tobytes(), 9)
    body = b"".join([
        _HEAD.pack(MAGIC, len(lengths), block, len(keys), len(ids), bits), struct.pack("<I", len(table)), table,
        np.array([k is not None for k in keys], dtype=np.uint8).tobytes(),
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(), starts.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(),
        checkpoints.astype("<i8").tobytes(), data.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A file's tables; ``ids`` decodes any of its blocks."""

    def __init__(self, raw: bytes):
        if len(raw) < _HEAD.size + 8 or raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not a token file, or a damaged one")
        _, vocabulary, self.block, docs, self.total, bits = _HEAD.unpack_from(raw)
        at = _HEAD.size
        (size,) = struct.unpack_from("<I", raw, at)
        self.lengths = np.frombuffer(zlib.decompress(raw[at + 4: at + 4 + size]), dtype=np.uint8)
        at += 4 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        has = take("u1", docs)
        keys = take("<i8", docs)
        self.keys = [int(k) if h else None for k, h in zip(keys, has, strict=True)]
        self.starts, self.sizes = take("<i8", docs), take("<i8", docs)
        self.checkpoints = take("<i8", -(-self.total // self.block))
        self.data = take("u1", (bits + 7) // 8)

    def ids(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        return unpack(self.data, self.checkpoints, self.total, self.lengths, self.block, slice(first, stop))

    def documents(self, limit: int | None = None) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first document, last + 1, the ids of each): as many at once as have ``limit`` ids, or a longer one alone."""
        limit, ends, a = limit or DECODED_IDS, np.cumsum(self.sizes), 0
        while a < len(ends):
            start = int(ends[a] - self.sizes[a])
            b = max(a + 1, int(np.searchsorted(ends, start + limit, side="right")))
            first = start // self.block
            ids = self.ids(first, -(-int(ends[b - 1]) // self.block)).astype("<u4", copy=False)
            at = first * self.block
            yield a, b, [ids[e - n - at: e - at] for e, n in zip(ends[a:b].tolist(), self.sizes[a:b].tolist(), strict=True)]
            a = b


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
          shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenise and write ``docs`` in the order of an integer ``key``; the manifest (path, docs, ids, bytes)."""
    spark = docs.sparkSession
    held = shared_path(spark, "token-ids")
    tokenise(docs, path, key, text, end_id).write.option("compression", "zstd").parquet(held)
    rows = spark.read.parquet(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(_from_planes(x.as_buffer()), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # At most one row for every entry of the vocabulary.
    freq = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r["id"] for r in freq)]) + 1, dtype=np.int64)
    for r in freq:
        counts[r["id"]] = r["n"]
    codebook = spark.sparkContext.broadcast(code_lengths(counts))
    # And one row for every partition: the ids of all earlier partitions.
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), np.append(0, np.cumsum([n for _, n in sizes])).tolist(), strict=False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = codebook.value
        codes = canonical_codes(lengths)
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        held, done = [], []

        def close() -> None:
            name, sizes = f"{uuid.uuid4().hex}.huf", np.array([len(x) for _, _, x in held])
            raw = shard_bytes([k for k, _, _ in held], np.array([s for _, s, _ in held]), sizes,
                              np.concatenate([x for _, _, x in held]), lengths, codes)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(raw)
            done.append((f"{folder.rstrip('/')}/{name}", len(held), int(sizes.sum()), len(raw)))

        size, last = 0, None
        for batch in batches:
            keys, parts, starts = (batch.column(i).to_pylist() for i in range(3))
            for i, x in enumerate(batch.column(3)):
                ids = _from_planes(x.as_buffer())
                if held and (parts[i] != last or size >= shard_ids):
                    close()
                    held, size = [], 0
                held.append((keys[i], before[parts[i]] + starts[i], ids))
                size, last = size + len(ids), parts[i]
        if held:
            close()
            held = []
        C.release_memory()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["path", "docs", "ids", "bytes"])

    return materialize(rows.select("key", "part", "before", "ids")
                       .mapInArrow(encode, "path string, docs long, ids long, bytes long"), "token-manifest")


def read(paths: DataFrame, files: int, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) per document of the files in column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_folder(path)
                with fs.open_input_file(inner) as f:
                    shard = Shard(f.read())
                for a, b, parts in shard.documents():
                    columns = [pa.array(shard.keys[a:b], pa.int64()), pa.array(shard.starts[a:b]), pa.array(shard.sizes[a:b]),
                               pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    if ids:
                        columns.append(pa.array([p.tolist() for p in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        C.release_memory()

    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return paths.select("path").repartition(max(1, files)).mapInArrow(run, schema).withColumnRenamed("key", key)


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise and write all documents, then read every file back."""
    manifest = write(C.table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), tokenizer_path())
    return read(manifest, manifest.count(), ids=False)
