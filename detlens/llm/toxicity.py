"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word and the mean embedding of its character n-grams
(both hashed). Windows of ``WINDOW`` words run through a GRU in either direction; attention
pools the states and inputs of a window into one score. A document's score is that of its
worst window; all windows of the whole text, one every ``STRIDE`` words, are scored.

Training takes at most ``TRAIN_DOCS`` labelled documents and ``TRAIN_BYTES`` of their text (in
the order of a hash of the key, those with ``crc32(key) mod 4 = 2`` left out) to one task.
A label holds for a whole document, so every step trains on the document's worst window under
the current weights. One dimension of either embedding is fixed: the smoothed log-odds of the word
or the n-grams, which a training document takes from the other half of the documents.

Cases: null, empty and wordless texts score 0; a null key is read as the empty string for the
split; without labelled documents of both kinds every text with words gets the share of toxic labels;
several labels for one document count as toxic if one is; repeated rows get equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C

WINDOW, STRIDE = 32, 24
#: Labelled documents, and bytes of their text, that training uses at most.
TRAIN_DOCS, TRAIN_BYTES = 4000, 12 << 20
THRESHOLD = 0.3
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 16
DIM, HIDDEN, ATTEND = 8, 8, 8
#: An epoch has about so many steps of at least so many windows.
EPOCHS, STEPS, LEAST_BATCH = 4, 36, 16
#: Windows that go through the network at once.
CHUNK = 4096
_PREFIX = np.uint64(0x517CC1B727220A95)


class Features:
    """The words of a slice as numbers of distinct words, and the distinct words' features."""

    def __init__(self, texts: C.Texts):
        parts, i = [], 0
        while i < len(texts):  # a slice at a time: training brings all its texts at once
            j = max(i + 1, int(np.searchsorted(texts.hi, texts.lo[i] + C.SLICE_BYTES, side="right")))
            lo = texts.lo[i]
            some = C.Texts(texts.data[lo: texts.hi[j - 1]], texts.lo[i:j] - lo, texts.hi[i:j] - lo)
            w = C.Words(some, C.ALNUM)
            parts.append((w.start + lo, w.end + lo, w.count, C.span_hashes(some.data, w.start, w.end, lower=True)))
            i = j
        start, end, self.count, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.cumsum(self.count) - self.count
        code, unique = pd.factorize(hashes)
        self.code = code.astype(np.int32)
        at = np.empty(len(unique), dtype=np.int64)
        at[self.code[::-1]] = np.arange(len(hashes))[::-1]
        size = end[at] - start[at]
        end = np.cumsum(size)  # from here on in the distinct words' own bytes
        data = texts.data[np.arange(size.sum()) + np.repeat(start[at] - end + size, size)]
        start = end - size
        self.word = (unique & np.uint64(WORD_BUCKETS - 1)).astype(np.uint16)
        heads = [C.span_hashes(data, start, np.minimum(start + n, end), lower=True) + _PREFIX for n in (3, 4, 5)]
        self.n_grams = np.maximum(0, size - 3)
        total = np.cumsum(self.n_grams)
        pos = np.arange(self.n_grams.sum()) + np.repeat(start - total + self.n_grams, self.n_grams)
        grams = C.span_hashes(data, pos, pos + 4, lower=True)
        bucket = lambda h: (C.mix(h) & np.uint64(CHAR_BUCKETS - 1)).astype(np.uint16)
        self.heads, self.grams = np.stack([bucket(h) for h in heads], axis=1), bucket(grams)
        self.grams_first = total - self.n_grams

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all windows."""
        n = np.where(self.count > 0, 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        return text, self.first[text] + nth * STRIDE, np.minimum(WINDOW, self.count[text] - nth * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Log-odds by word bucket and by n-gram bucket.
Odds = tuple[np.ndarray, np.ndarray]


def _gram_sums(f: Features, table: np.ndarray) -> np.ndarray:
    """For every distinct word, the sum of the table's rows for its n-grams."""
    out = table[f.heads].sum(axis=1)
    some = np.flatnonzero(f.n_grams)
    if len(some):
        out[some] += np.add.reduceat(table[f.grams], f.grams_first[some], axis=0)
    return out


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        rep = 2 * HIDDEN + 2 * DIM
        self.words = (0.05 * rng.standard_normal((WORD_BUCKETS, DIM))).astype(np.float32)
        self.chars = (0.05 * rng.standard_normal((CHAR_BUCKETS, DIM))).astype(np.float32)
        self.p = {
            "input": init(2 * DIM, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": init(HIDDEN, 3 * HIDDEN), "backward": init(HIDDEN, 3 * HIDDEN),
            "attend": 0.3 * init(rep, ATTEND), "attend_bias": np.zeros(ATTEND, np.float32), "query": 0.3 * init(ATTEND),
            "out": 0.1 * init(rep), "out_bias": np.zeros(1, np.float32)}
        for i in (0, DIM):  # attention begins with the words whose log-odds are high
            self.p["attend"][2 * HIDDEN + i, 0] = 0.7
            self.p["out"][2 * HIDDEN + i] = 1.0
        self.p["query"][0] = 3.0
        self.odds: Odds = (np.zeros(WORD_BUCKETS, np.float32), np.zeros(CHAR_BUCKETS, np.float32))
        self.prior: float | None = None

    def inputs(self, f: Features, odds: Odds | None = None) -> np.ndarray:
        """The input vectors of the distinct words. The first dimension of either half is log-odds."""
        by_word, by_gram = odds or self.odds
        mean = lambda table: _gram_sums(f, table) / (3 + f.n_grams)[:, None].astype(np.float32)
        out = np.concatenate([self.words[f.word], mean(self.chars)], axis=1)
        out[:, 0], out[:, DIM] = by_word[f.word], mean(by_gram[:, None])[:, 0]
        return out

    def _gru(self, gates: np.ndarray, weights: np.ndarray, mask: np.ndarray, reverse: bool, keep: bool):
        n, steps = gates.shape[:2]
        h = np.zeros((n, HIDDEN), np.float32)
        states, kept = np.empty((n, steps, HIDDEN), np.float32), []
        for t in range(steps - 1, -1, -1) if reverse else range(steps):
            u = h @ weights
            zr = _sigmoid(gates[:, t, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[:, t, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            m = mask[:, t, None]
            if keep:
                kept.append((t, h, z, r, new, u[:, 2 * HIDDEN:], m))
            h = h + m * (1 - z) * (new - h)
            states[:, t] = h
        return states, kept

    def run(self, x: np.ndarray, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows with inputs x, their gates' inputs and a mask of real words."""
        p, h3 = self.p, 3 * HIDDEN
        forward, kept_f = self._gru(projected[..., :h3], p["forward"], mask, False, keep)
        backward, kept_b = self._gru(projected[..., h3:], p["backward"], mask, True, keep)
        rep = np.concatenate([forward, backward, x], axis=2)
        u = np.tanh(rep @ p["attend"] + p["attend_bias"])
        e = np.where(mask > 0, u @ p["query"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntd->nd", a, rep)
        return pooled @ p["out"] + p["out_bias"][0], (rep, u, a, pooled, kept_f, kept_b)

    def gradients(self, x, projected, mask, label) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the log-loss by weights, by inputs x and by gates' inputs."""
        p = self.p
        logit, (rep, u, a, pooled, kept_f, kept_b) = self.run(x, projected, mask, True)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_rep = a[..., None] * d_pooled[:, None]
        d_a = np.einsum("ntd,nd->nt", rep, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        g["query"] = np.einsum("nt,nta->a", d_e, u)
        d_u = d_e[..., None] * p["query"] * (1 - u * u)
        g["attend"], g["attend_bias"] = np.einsum("ntd,nta->da", rep, d_u), d_u.sum(axis=(0, 1))
        d_rep += d_u @ p["attend"].T
        d_gates = np.empty_like(projected)
        for k, (name, kept) in enumerate((("forward", kept_f), ("backward", kept_b))):
            g[name] = np.zeros_like(p[name])
            d_h = np.zeros((len(label), HIDDEN), np.float32)
            for t, h, z, r, new, un, m in reversed(kept):
                d_h = d_h + d_rep[:, t, k * HIDDEN: (k + 1) * HIDDEN]
                d = m * d_h
                d_n = d * (1 - z) * (1 - new * new)
                d_z, d_r = d * (h - new) * z * (1 - z), d_n * un * r * (1 - r)
                d_gates[:, t, 3 * k * HIDDEN: 3 * (k + 1) * HIDDEN] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[name] += h.T @ d_u
                d_h = d_h - d * (1 - z) + d_u @ p[name].T
        g["input"], g["bias"] = np.einsum("ntd,ntg->dg", x, d_gates), d_gates.sum(axis=(0, 1))
        return g, d_rep[..., 2 * HIDDEN:] + d_gates @ p["input"].T, d_gates

    def score_windows(self, f: Features, texts: np.ndarray | None = None,
                      odds: Odds | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words, logit) of all windows, or of those of the texts that are marked."""
        text, first, n = f.windows()
        if texts is not None:
            text, first, n = text[texts[text]], first[texts[text]], n[texts[text]]
        vectors = self.inputs(f, odds)
        gates = vectors @ self.p["input"] + self.p["bias"]
        logits = np.empty(len(text), np.float32)
        order = np.argsort(n, kind="stable")
        for k in range(0, len(order), CHUNK):
            part = order[k: k + CHUNK]
            code, mask = _window_codes(f, first[part], n[part])
            logits[part] = self.run(vectors[code], gates[code], mask)[0]
        return text, first, n, logits

    def scores(self, texts: C.Texts) -> np.ndarray:
        """A score for every text of a slice: that of its worst window, 0 without words."""
        f = Features(texts)
        out = np.zeros(len(texts))
        if self.prior is not None:
            out[f.count > 0] = self.prior
        elif f.count.any():
            text, _, _, logits = self.score_windows(f)
            begins = np.flatnonzero(np.append(True, np.diff(text) > 0))
            out[text[begins]] = _sigmoid(np.maximum.reduceat(logits.astype(np.float64), begins))
        return out


def _window_codes(f: Features, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(int(n.max()))
    inside = steps < n[:, None]
    return f.code[np.where(inside, first[:, None] + steps, first[:, None])], inside.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit a network to whole texts with labels 0 or 1."""
    net = Network(seed)
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.prior = float(labels.mean()) if len(labels) else 0.0
        return net
    (_, _, slice_), = C.slices(pa.array(texts, pa.large_string()), 1 << 62)
    f = Features(slice_)
    # A document trains with log-odds that the other half of the documents gave: its own would tell its label.
    fold = np.arange(len(labels)) % 2
    halves = [_log_odds(f, labels, fold != k) for k in (0, 1)]
    net.odds = _log_odds(f, labels, np.ones(len(labels), dtype=bool))
    net.p["out_bias"][0] = np.log(labels.mean() / (1 - labels.mean()))
    rng = np.random.default_rng(seed)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    squares = {"words": np.full(WORD_BUCKETS, 1e-6, np.float32), "chars": np.full(CHAR_BUCKETS, 1e-6, np.float32)}
    weight = np.array([1.0, min(5.0, float((1 - labels.mean()) / labels.mean()))], np.float32)
    step = 0
    for epoch in range(epochs):
        text, first, n, logits = (np.concatenate(x) for x in zip(
            *(net.score_windows(f, fold == k, halves[k]) for k in (0, 1)), strict=True))
        by = np.lexsort((-logits, text))
        worst = by[np.append(True, np.diff(text[by]) > 0)]
        other = rng.integers(0, len(text), len(worst) // 2)  # some more windows of clean documents
        chosen = rng.permutation(np.concatenate([worst, other[labels[text[other]] == 0]]))
        rate = 0.01 * (1 - epoch / epochs)
        batch = max(LEAST_BATCH, len(chosen) // STEPS)
        for k in range(0, len(chosen), batch):
            part = chosen[k: k + batch]
            code, mask = _window_codes(f, first[part], n[part])
            words, local = np.unique(code, return_inverse=True)
            sub = _some(f, words)
            each = [net.inputs(sub, h) for h in halves]
            x = np.where(fold[text[part]][:, None, None] == 0, *(v[local.reshape(code.shape)] for v in each))
            y = labels[text[part]]
            g, d_x, _ = net.gradients(x, x @ net.p["input"] + net.p["bias"], mask, y)
            d_words = np.zeros_like(each[0])
            np.add.at(d_words, local.ravel(), (d_x * mask[..., None] * weight[y.astype(int)][:, None, None]).reshape(-1, d_x.shape[2]))
            step += 1
            for name, grad in g.items():
                m, v = adam[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            d_chars = d_words[:, DIM:] / (3 + sub.n_grams)[:, None]
            _adagrad(net.words, squares["words"], sub.word, d_words[:, :DIM], 5 * rate)
            _adagrad(net.chars, squares["chars"], np.concatenate([sub.heads.ravel(), sub.grams]),
                     np.concatenate([np.repeat(d_chars, 3, axis=0), np.repeat(d_chars, sub.n_grams, axis=0)]), 5 * rate)
    return net


def _some(f: Features, words: np.ndarray) -> Features:
    """The features of some of the distinct words."""
    out = object.__new__(Features)
    out.word, out.heads, out.n_grams = f.word[words], f.heads[words], f.n_grams[words]
    total = np.cumsum(out.n_grams)
    out.grams_first = total - out.n_grams
    out.grams = f.grams[np.arange(total[-1]) + np.repeat(f.grams_first[words] - out.grams_first, out.n_grams)]
    return out


def _adagrad(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    where, local = np.unique(rows, return_inverse=True)
    total = np.zeros((len(where), table.shape[1]), np.float32)
    np.add.at(total, local, grad)
    squares[where] += (total * total).mean(axis=1)
    table[where] -= rate * total / np.sqrt(squares[where])[:, None]


def _log_odds(f: Features, labels: np.ndarray, use: np.ndarray) -> Odds:
    """How much likelier a toxic document among those marked has a word or n-gram, as smoothed log-odds."""
    share = np.clip(labels[use].mean() if use.any() else 0.5, 0.01, 0.99)
    seen = [np.zeros((2, buckets), dtype=np.int64) for buckets in (WORD_BUCKETS, CHAR_BUCKETS)]
    for d in np.flatnonzero(use):
        word = np.unique(f.code[f.first[d]: f.first[d] + f.count[d]])
        n = f.n_grams[word]
        grams = f.grams[np.arange(n.sum()) + np.repeat(f.grams_first[word] - np.cumsum(n) + n, n)]
        for table, buckets in zip(seen, (f.word[word], np.concatenate([f.heads[word].ravel(), grams])), strict=True):
            table[int(labels[d] > 0), np.unique(buckets)] += 1
    return tuple(np.clip(np.log(bad + 2 * share) - np.log(good + 2 * (1 - share)) - np.log(share / (1 - share)), -1, 4).astype(np.float32)
                 for good, bad in seen)


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
        docs_bound: int = TRAIN_DOCS, bytes_bound: int = TRAIN_BYTES) -> Network:
    """Train on a bounded sample of the labelled documents that aren't held out."""
    marks = (labels.filter(F.col(toxic).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
             .groupBy(F.col(key).alias("key")).agg(F.max(toxic).cast("int").alias("label"))
             .orderBy(F.xxhash64("key"), "key").limit(docs_bound))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    sized = (rows.join(F.broadcast(marks), "key")  # at most docs_bound rows
             .select("key", "label", "text", F.octet_length("text").cast("long").alias("n")))
    # Documents of a fair share of the bound are always taken whole; a longer one has no place in the sample.
    taken = sized.filter(F.col("n") <= bytes_bound // max(1, docs_bound) * 8).orderBy(F.xxhash64("key"), "key", "text").limit(docs_bound)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, values, total = [], [], 0
        for batch in batches:
            for label, content, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += n
                if total <= bytes_bound:
                    texts.append(content)
                    values.append(label)
        network = pickle.dumps(train(texts, np.array(values)))
        texts.clear()
        C.release_memory()  # the worker lives on
        yield pa.RecordBatch.from_arrays([pa.array([network])], names=["network"])

    # The sample is in one partition, in order; one task trains, and the driver gets the weights alone.
    return pickle.loads(taken.select("label", "text", "n").coalesce(1).mapInArrow(learn, "network binary").first()["network"])


def score(rows: DataFrame, network: Network, key: str = "key", text: str = "text") -> DataFrame:
    """(key, score) for every row; ``key`` may be a struct of all its columns."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in C.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(shared.value.scores(texts))], names=["key", "score"])
        C.release_memory()

    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, C.with_key(rows, "score double"))


def op6_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document with a network trained on the labels that aren't held out."""
    docs = C.table(spark, sf_dir, "documents")
    network = fit(docs, C.table(spark, sf_dir, "labels"))
    scored = score(docs, network, "doc_id").withColumnRenamed("key", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
