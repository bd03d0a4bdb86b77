import random
import re
from collections import Counter

import pytest

from detlens.llm import hostrules as H


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(repeated))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    some = ["", None, " \n\n ", "a", "a\na\na", "a b c a b c", "x\n x\nx", "日本 é\r\n日本 é\n#$|", "a b a b a b a b", "\n", "a\n\nb\n\n", "a\x0bb\x1fc d"]
    return some + ["".join(rng.choice("ab \n#\té") for _ in range(rng.randrange(200))) for _ in range(200)]


def test_measures_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    got = {r.key: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in H.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bad_host_is_rejected_and_small_host_is_not(spark):
    rng = random.Random(1)
    good = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    rows = [(i, good() if i % 10 else "short", f"h{i % 8}") for i in range(400)]
    rows += [(1000 + i, "short" if i % 20 else good(), "bad") for i in range(200)] + [(2000, "short", "tiny"), (2001, good(), "tiny"), (2002, good(), None)]
    out = {r.doc_id: r for r in H.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[1000].kept and not out[1001].kept and out[1000].base_failed is False  # good text on a bad host
    assert out[2001].kept and out[2002].kept and not out[2000].kept
    assert all(out[i].kept == (i % 10 != 0) for i in range(400))


def test_prior_falls_back_to_the_mean():
    assert H.beta_prior(0, 0, 0, 0.0, 0.0) == (None, None, 0.0)
    alpha, beta, mean = H.beta_prior(100, 10, 2, 2 * 25 / 50, 2 * 2500)  # two equal hosts
    assert alpha is None and mean == 0.1
    alpha, beta, mean = H.beta_prior(100, 50, 2, 45 * 45 / 50 + 5 * 5 / 50, 5000)
    assert abs(alpha / (alpha + beta) - mean) < 1e-12 and alpha + beta < 10


def test_odd_rows(spark, odd, nothing):
    rows = H.apply_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 5))
    assert H.apply_rules(nothing).collect() == []
