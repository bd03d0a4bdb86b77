import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.llm import toxicity as T


def texts_of(values):
    return next(t for _, _, t in C.slices(pa.array(values, pa.string()), 1 << 40))


def sample(n, seed, share=0.2):
    """Texts of invented words; toxic ones hold a few words with a telling stem, wherever it may be."""
    rng = random.Random(seed)
    syllable = ["ba", "de", "fi", "ko", "lu", "mo", "ne", "pi", "ra", "so", "tu", "ve"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randrange(1, 4)))
    out, labels = [], []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(3, 150))]
        y = int(rng.random() < share)
        for _ in range(2 * y):
            w[rng.randrange(len(w))] = "zx" + rng.choice("aeiou") + "qq" + word()
        out.append(" ".join(w))
        labels.append(y)
    return out, np.array(labels)


@pytest.fixture(scope="module")
def network():
    return T.train(*sample(600, 1))


def test_held_out_accuracy(network):
    texts, y = sample(400, 2)
    hit = network.scores(texts_of(texts)) >= T.THRESHOLD
    assert hit[y == 1].mean() >= 0.95 and hit[y == 0].mean() <= 0.02


def test_late_words_in_a_long_text_count(network):
    clean = sample(60, 3, 0)[0]
    long = " ".join(clean * 20)
    scores = network.scores(texts_of([long, long + " zxaqqko", "zxaqqko " + long]))
    assert scores[0] < T.THRESHOLD <= scores[1] and scores[2] >= T.THRESHOLD


def test_windows_cover_every_word(network):
    for n in [0, 1, 31, 32, 33, 56, 57, 80, 300]:
        f = T.Features(texts_of([" ".join(f"w{i}" for i in range(n)), "x y"]))
        text, first, size = f.windows()
        seen = {i for t, a, k in zip(text, first, size, strict=True) if t == 0 for i in range(a, a + k)}
        assert seen == set(range(n)) and (size <= T.WINDOW).all() and (size > 0).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = T.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.standard_normal((4, 7, 2 * T.DIM))
    mask = (np.arange(7) < np.array([[7], [3], [1], [5]])).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss(x):
        z = net.run(x, x @ net.p["input"] + net.p["bias"], mask)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, dx, _ = net.gradients(x, x @ net.p["input"] + net.p["bias"], mask, y)
    for name, grad in g.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(5, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss(x)
            flat[i] = old - 1e-4
            down = loss(x)
            flat[i] = old
            assert abs((up - down) / 2e-4 - grad.reshape(-1)[i]) < 2e-4, name
    for _ in range(10):
        at = tuple(rng.integers(0, s) for s in (4, 7, 2 * T.DIM))
        if not mask[at[:2]]:
            continue
        z = x.copy()
        z[at] += 1e-4
        up = loss(z)
        z[at] -= 2e-4
        assert abs((up - loss(z)) / 2e-4 - dx[at]) < 2e-4


def test_scores_do_not_depend_on_neighbours(network):
    texts, _ = sample(30, 4)
    texts += ["", " \n", "日本 é", texts[0]]
    alone = [float(network.scores(texts_of([t]))[0]) for t in texts]
    assert np.allclose(network.scores(texts_of(texts)), alone, atol=1e-5)
    assert alone[-4:-2] == [0.0, 0.0]


def test_without_labels_of_both_kinds():
    assert T.train([], np.array([])).scores(texts_of(["a", ""])).tolist() == [0.0, 0.0]
    assert T.train(["a", "b"], np.array([1, 1])).scores(texts_of(["c", ""])).tolist() == [1.0, 0.0]


def test_fit_and_score_in_spark(spark, nothing, odd):
    texts, y = sample(500, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = T.fit(docs, labels)
    rows = T.score(docs, net, "doc_id").withColumn("held", T.held_out("key")).collect()
    assert all(r.held == (zlib.crc32(str(r.key).encode()) % 4 == 2) for r in rows)
    assert np.mean([(r.score >= T.THRESHOLD) == y[r.key] for r in rows if r.held]) > 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.key: r.score for r in T.score(docs, T.fit(docs, flipped), "doc_id").collect()}
    assert all(other[r.key] == r.score for r in rows)
    got = T.score(C.packed(odd), net).select("key.*", F.col("score").alias("s")).collect()
    assert len(got) == odd.count() and all(r.s == 0.0 for r in got if r.doc_id in (1, 2, 3)) and all(0 <= r.s <= 1 for r in got)
    assert T.score(nothing, T.fit(nothing, labels), "doc_id").collect() == []
