import hashlib
import random
import re

import pytest

from detlens.llm import contamination as K

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    patterns = []
    for i, t in items:
        w = split(t)
        n = min(len(w), window)
        patterns += [("" if i is None else str(i), w[k:k + n]) for k in range(len(w) - n + 1) if n]
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(i)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = K.decide(K.scan(d, b, **kw)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(12)]  # few words: many blocks collide
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(13, 40))) for i in range(20)]
    items += [(90, "v1 V2, v3"), (91, "lonely"), (92, None), (93, ""), (94, " ... "), (10, items[10][1]), (None, "v9 v9 v9 v9")]
    docs = [(i, text(rng.randrange(0, 400))) for i in range(40)]
    docs += [(100 + i, f"{text(50)} {items[i][1].upper()}! {text(20)}") for i in range(10)]
    docs += [(200, "LONELY"), (201, None), (202, ""), (203, items[3][1]), (203, items[3][1]), (None, items[4][1])]
    return docs, items


def test_equals_brute_force(spark, case):
    docs, items = case
    assert run(spark, docs, items) == brute(docs, items)


def test_benchmark_in_several_blocks(spark, case):
    docs, items = case
    assert run(spark, docs, items, block_words=100) == brute(docs, items)


def test_long_items_and_documents(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(K, "PIECE_WORDS", 40)
    item = " ".join(f"x{rng.randrange(10**6)}" for _ in range(500))
    docs = [(1, "a b c " * 3000 + item + " d e f" * 3000), (2, " ".join(item.split()[37:50])), (3, " ".join(item.split()[37:49]))]
    got = run(spark, docs, [(7, item)])
    assert got == brute(docs, [(7, item)])
    assert [r[2] for r in got] == [500, 13, 0]


def test_empty_tables(spark, case):
    docs, items = case
    assert run(spark, [], items) == []
    assert all(r[2] == 0 for r in run(spark, docs, []))


def test_hits_are_ranges(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c"), (2, "c d"), (3, "f")], "item_id long, text string")
    assert K.scan(d, b).first().hits == [1, 4, 5, 6]


def test_windows_of_one_suffix_bucket(spark, monkeypatch):
    """Test strings that agree in their first and last words, and one that many items repeat, are told apart by comparison."""
    monkeypatch.setattr(K, "COMPARED", 3)
    middle = lambda i: " ".join(f"m{(i + j) % 7}" for j in range(9))
    items = [(i, f"the of {middle(i)} and the") for i in range(7)] + [(20 + i, f"THE of {middle(0)} and the") for i in range(30)] + [(90, "and the"), (91, "the")]
    docs = [(i, f"x y the of {middle(i)} and the. z") for i in range(9)] + [(50, f"the of {middle(1)} and then"), (51, "the of and the"), (52, "and, The")]
    assert run(spark, docs, items) == brute(docs, items)
