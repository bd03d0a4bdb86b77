import random

import numpy as np
import pyarrow as pa

from detlens.llm import common as C


def hashes(texts, lower=False):
    out = []
    for _, _, t in C.slices(pa.array(texts, pa.large_binary())):
        out += C.span_hashes(t.data, t.lo, t.hi, lower).tolist()
    return out


def test_equal_spans_only_hash_alike():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(30))) for _ in range(20000)]
    by = {}
    for t, h in zip(texts, hashes(texts)):
        assert by.setdefault(h, t) == t
    assert len(by) == len(set(texts))


def test_thue_morse_strings_differ():
    """Sums of byte values times powers of one odd number modulo 2^64 can't tell these apart."""
    for size in (1024, 2048, 4096, 8192):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(size)).encode()
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        a, b, c = hashes([word, other, word])
        assert a == c != b


def test_the_place_in_the_buffer_and_the_batch_do_not_matter(monkeypatch):
    texts = [b"", b"x", b"twelve bytes", b"Twelve Bytes", b"z" * 5000, b"", b"x" * 8, b"x" * 9, b"z" * 5000]
    whole = hashes(texts)
    assert whole == [hashes([t])[0] for t in texts] and whole[4] == whole[8] and whole[0] == whole[5]
    assert hashes(texts, lower=True)[2] == hashes(texts, lower=True)[3] != whole[3]
    monkeypatch.setattr(C, "PIECES", 3)
    assert hashes(texts) == whole
    assert C.span_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
