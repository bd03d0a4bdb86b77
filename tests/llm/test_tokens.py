import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from detlens.llm import common as C
from detlens.llm import tokens as T

PATH = T.tokenizer_path()
ODD = ["", " ", "\n", "a b", "a  b", " a", "a ", "it's a dog's", "x\n\ny", "x\n y", "x \ny", "é è", "日本 語 x", "a b c", "12 34 5,6",
       "word,\nNext  two", "<|endoftext|> a", "hello <|endoftext|> world", "a<|endoftext|>b, c d<|endoftext|><|endoftext|>\n", "<|endoftext", "|> x y", "<|ENDOFTEXT|> a", "\t a\tb", "a\r\nb c", "x" * 500 + " y", "a×, b÷. c", "don't, we'll. x's", "ab_c-d (e) \"f\" g",
       "é, è. ß;", "x', y", "ŉn, ɏ. ȁ!", "á b́, c", "\U0001f600 \U0001f600, a", "a\x85b  c", "1a, a1. 2"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def encode(texts):
    ids, counts = [], []
    for _, _, s in C.slices(pa.array(texts, pa.string())):
        i, n = T.encoder(PATH).encode(s)
        ids.append(i)
        counts.append(n)
    return np.split(np.concatenate(ids), np.cumsum(np.concatenate(counts))[:-1])


def test_pieces_give_the_ids_of_the_whole_text(reference, spark, sf_dir, monkeypatch):
    rng = random.Random(1)
    parts = ["a", "é", "×", " ", " ", "\n", ".", ",", "'", "'s", "1", "日", " ", "\t", "ab", "Zz", "<|endoftext|>", "-", "́", "ʼ"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in encode(texts)] == [reference(t) for t in texts]
    monkeypatch.setattr(T, "REMEMBERED", 50)  # forgets all the time
    assert [x.tolist() for x in encode(ODD)] == [reference(t) for t in ODD]


def huffman(counts):
    """Sum of optimal code lengths times counts, by merging the two least again and again."""
    import heapq

    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 17, 500])
def test_code_lengths(n):
    rng = np.random.default_rng(n)
    counts = np.append(0, rng.integers(1, 10_000, n))
    lengths = T.code_lengths(counts, 20)
    assert lengths[0] == 0 and (lengths[1:] > 0).all()
    if n > 1:
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1 and (lengths * counts).sum() == huffman(counts)


def brute_limited(counts, limit):
    """Least total over all monotone length choices with Kraft sum at most 1."""
    best = [None]
    counts = sorted(counts, reverse=True)

    def go(i, least, room, total):
        if best[0] is not None and total >= best[0]:
            return
        if i == len(counts):
            best[0] = total
            return
        for n in range(least, limit + 1):
            if (1 << (limit - n)) * (len(counts) - i) <= room << 30 and (1 << (limit - n)) <= room:
                go(i + 1, n, room - (1 << (limit - n)), total + n * counts[i])

    go(0, 1, 1 << limit, 0)
    return best[0]


def test_limited_lengths_are_optimal():
    rng = random.Random(3)
    for _ in range(25):
        counts = [2 ** rng.randrange(12) + rng.randrange(3) for _ in range(rng.randrange(2, 8))]
        for limit in (3, 4):
            lengths = T.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit and int((lengths * np.array(counts)).sum()) == brute_limited(counts, limit)
    with pytest.raises(ValueError, match="do not fit"):
        T.code_lengths(np.ones(9), 3)


def test_blocks_decode_alone():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    lengths = T.code_lengths(np.bincount(ids, minlength=1000), 12)
    marks, data, bits = T.pack(ids, lengths, T.canonical_codes(lengths), 64)
    assert bits == lengths[ids].sum() and len(marks) == 79
    assert (T.unpack(data, marks, 5000, lengths, 64) == ids).all()
    for k in (0, 5, 77, 78):
        assert (T.unpack(data, marks, 5000, lengths, 64, slice(k, k + 1)) == ids[64 * k: 64 * k + 64]).all()


def test_shard_round_trip_and_damage():
    ids = np.array([0, 5, 0, 7, 7, 0])
    lengths = T.code_lengths(np.bincount(ids))
    raw = T.shard_bytes([1, None, 3], np.array([10, 11, 13]), np.array([1, 2, 3]), ids, lengths, T.canonical_codes(lengths))
    s = T.Shard(raw)
    assert (s.keys, s.starts.tolist(), s.sizes.tolist(), s.ids().tolist()) == ([1, None, 3], [10, 11, 13], [1, 2, 3], ids.tolist())
    for bad in (raw[:-1], b"", raw[:20] + b"\xff" + raw[21:]):
        with pytest.raises(ValueError, match="damaged"):
            T.Shard(bad)


def expected(rows, reference):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*reference(text), 0], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def through(spark, rows, tmp_path, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = T.write(df, f"file://{tmp_path}/t", PATH, **kw)
    got = T.read(manifest, manifest.count()).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]), manifest


def test_files(spark, tmp_path, reference, odd_rows):
    rows = list(enumerate(ODD, -5)) + [(r[0], r[1]) for r in odd_rows if r[0] in (1, 9, 11)]
    rows = [(i, t) for i, t in rows if i != 9 or len(t or "") > 99]
    rows = list({i: (i, t) for i, t in rows}.values())
    got, manifest = through(spark, rows, tmp_path, shard_ids=200)
    assert got == expected(rows, reference)
    assert manifest.count() > 2


def test_repeated_rows_and_null_keys(spark, tmp_path, reference):
    rows = [(None, "b c"), (2, "same"), (2, "same"), (1, None), (2, "other")]
    got, _ = through(spark, rows, tmp_path)
    assert [r[0] for r in got] == [None, 1, 2, 2, 2] and [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got])[:-1]).tolist()
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows, reference))


def test_empty_table(spark, tmp_path):
    assert through(spark, [], tmp_path)[0] == []


def test_a_worker_holds_a_part_of_a_file_and_of_a_batch(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 1 << 20
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    lengths = T.code_lengths(np.bincount(ids, minlength=50_001))
    sizes = np.append(rng.integers(1, 900, 1500), [1, 30_000, 1])
    sizes = np.append(sizes, n - sizes.sum())
    shard = T.Shard(T.shard_bytes(list(range(len(sizes))), np.cumsum(sizes) - sizes, sizes, ids, lengths, T.canonical_codes(lengths)))
    for limit in (n, 1 << 14):
        done = 0
        tracemalloc.start()
        for a, b, parts in shard.documents(limit):
            assert a == done and b - a == len(parts) and [len(p) for p in parts] == sizes[a:b].tolist()
            assert (np.concatenate(parts) == ids[sizes[:a].sum(): sizes[:b].sum()]).all()
            done = b
            if limit == 1 << 14 and sizes[a:b].sum() <= limit:
                assert tracemalloc.get_traced_memory()[1] < 24 << 20  # the whole file takes more than twice that
                tracemalloc.reset_peak()
        tracemalloc.stop()
        assert done == len(sizes)
    encoder, given = T.Encoder(PATH), []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.append(len(texts))
            return tokenizer.encode_batch(texts, add_special_tokens=add_special_tokens)

        encode_batch = encode_batch_fast

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counting()
    monkeypatch.setattr(T, "ENCODED", 50)
    for _, _, texts in C.slices(pa.array([" ".join(f"w{i}" for i in range(320))])):
        got, _ = encoder.encode(texts)
    assert got.tolist() == tokenizer.encode(" ".join(f"w{i}" for i in range(320)), add_special_tokens=False).ids
    assert max(given) <= 50 < sum(given)
