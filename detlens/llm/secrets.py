"""Secret scan: token-like strings, and a random forest that removes false positives.

Candidates are runs of ``[A-Za-z0-9+/_-]`` of at least ``MIN_LENGTH`` bytes that hold a digit, or that
follow a quote, ``=`` or ``:``, or that change between cases often. Each has its surroundings
(``CONTEXT`` characters on either side). The forest sees length, character transitions, dictionary
coverage, path signs and the neighbouring words, and is grown in numpy from at most ``TRAIN_ROWS``
labelled findings, chosen by a hash. Dictionary and word weights come from the same findings.

Findings can be labelled by hand (``scan(findings=...)``). Otherwise ``label_findings`` applies rules that are
sure in either direction and leaves the rest without a label: issuer formats and long mixed values
assigned to a credential name are secrets, numbers and hyphenated words are not.

Cases: null and empty texts have no candidates; repeated rows have equal findings each; a long run
is one candidate, read whole; without labels of both kinds every candidate gets the labelled share
(or 1 without any label: nothing is removed unlearned). Offsets and lengths count characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from detlens.llm import common as C
from detlens.session import materialize

MIN_LENGTH = 8
CONTEXT = 64
#: Labelled findings that the forest is grown from at most.
TRAIN_ROWS = 20_000
#: Longer findings are scored but not learned from.
TRAIN_LENGTH = 4096
THRESHOLD = 0.5
TREES, DEPTH, LEAST_LEAF, CUTS = 40, 10, 3, 24
#: A dictionary word occurs in the surroundings of at least so many findings.
DICTIONARY_COUNT = 3
#: Changes of the character class in a short value, and a byte in one of letters, after a credential's name that make it a
#: sure secret; with fewer it is neither.
SHORT_TURNS = 3
LETTER_TURNS = 0.4

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "+/_-")]] = True
_OPENS = np.zeros(256, dtype=bool)
_OPENS[list(map(ord, "\"'=:"))] = True
_ASSIGNS = np.zeros(256, dtype=bool)  # also with spaces after it
_ASSIGNS[list(map(ord, "=:"))] = True
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_WORD = re.compile(r"[^\W\d_]+")
_CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?"
_ASSIGNED = re.compile(_CREDENTIAL + r"[\"']?\s{0,3}(=|:|:=|=>)\s{0,3}[\"']?$")
#: Published formats of issuers' keys.
_ISSUED = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24}")
_NUMBER = re.compile(r"[0-9+/_-]+|([^\W\d]+-)+[^\W\d]+")


def candidate_spans(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of the candidates of a slice."""
    w = C.Words(texts, _TOKEN)
    long = np.flatnonzero(w.end - w.start >= MIN_LENGTH)
    start, end, doc = w.start[long], w.end[long], w.doc[long]
    kind = _CLASS[texts.data]
    digits = np.append(0, np.cumsum(kind == 3))
    turns = np.append(0, np.cumsum(np.append(False, (kind[1:] == 2) & (kind[:-1] == 1))))
    before = np.maximum(start - 1, 0)
    solid = np.maximum.accumulate(np.where((texts.data == 0x20) | (texts.data == 0x09), 0, np.arange(len(texts.data))))[before]
    opened = (_OPENS[texts.data[before]] | _ASSIGNS[texts.data[solid]] & (solid >= texts.lo[doc])) & (start > texts.lo[doc])
    keep = (digits[end] > digits[start]) | opened | (turns[end] - turns[np.minimum(start + 1, end)] >= 3)
    return doc[keep], start[keep], end[keep]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, candidate, before, after) of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in C.slices(batch.column(1)):
                doc, start, end = candidate_spans(texts)
                leads = np.append(0, np.cumsum((texts.data & 0xC0) != 0x80))
                raw = lambda lo, hi: texts.data[lo:hi].tobytes().decode("utf-8", "ignore")
                before = [raw(max(texts.lo[d], s - 4 * CONTEXT), s)[-CONTEXT:] for d, s in zip(doc, start, strict=True)]
                after = [raw(e, min(texts.hi[d], e + 4 * CONTEXT))[:CONTEXT] for d, e in zip(doc, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + doc)), pa.array(leads[start] - leads[texts.lo[doc]]),
                     pa.array([raw(s, e) for s, e in zip(start, end, strict=True)], pa.string()),
                     pa.array(before, pa.string()), pa.array(after, pa.string())],
                    names=["key", "start", "candidate", "before", "after"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, C.with_key(rows, "start long, candidate string, before string, after string"))


def label(candidate: str, before: str) -> int | None:
    """1 for a sure secret, 0 for a sure false positive, else None."""
    if _ISSUED.fullmatch(candidate):
        return 1
    if _NUMBER.fullmatch(candidate):
        return 0
    digit, letter = re.search(r"\d", candidate), re.search(r"[A-Za-z]", candidate)
    if _ASSIGNED.search(before):
        kind = _CLASS[np.frombuffer(candidate.encode(), dtype=np.uint8)]
        turns = int((kind[1:] != kind[:-1]).sum())
        if digit and letter:
            return 1 if len(candidate) >= 12 or turns >= SHORT_TURNS else None
        return 1 if len(candidate) >= 12 and turns >= LETTER_TURNS * len(candidate) else None
    if not digit or len(candidate) < 12:
        return 0
    return None


def label_findings(found: DataFrame) -> DataFrame:
    """Add ``secret`` (1, 0 or null) to candidates by the sure rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [label(c, b) for c, b in zip(batch.column("candidate").to_pylist(), batch.column("before").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int32())], names=[*batch.schema.names, "secret"])

    return found.mapInArrow(run, StructType([*found.schema, StructField("secret", IntegerType())]))


# --- features -------------------------------------------------------------------------------


def _neighbours(before: str, after: str) -> tuple[str, str]:
    left, right = _WORD.findall(before), _WORD.findall(after)
    return (left[-1].lower() if left else ""), (right[0].lower() if right else "")


class Vocabulary:
    """What the labelled findings teach about words: a dictionary, and log-odds of neighbours."""

    def __init__(self, rows: list[tuple[str, str, str]], labels: np.ndarray):
        seen = Counter(w for _, b, a in rows for w in {x.lower() for x in _WORD.findall(b) + _WORD.findall(a)})
        self.words = {w for w, n in seen.items() if n >= DICTIONARY_COUNT and len(w) >= 3}
        good, bad = [Counter(), Counter()], [Counter(), Counter()]
        for (_, b, a), y in zip(rows, labels, strict=True):
            for i, w in enumerate(_neighbours(b, a)):
                (bad if y else good)[i][w] += 1
        share = min(max(float(np.mean(labels)), 0.01), 0.99) if len(labels) else 0.5
        self.odds = [{w: math.log((bad[i][w] + share) / (good[i][w] + 1 - share)) - math.log(share / (1 - share))
                      for w in bad[i].keys() | good[i].keys() if bad[i][w] + good[i][w] >= 2} for i in range(2)]

    def features(self, candidate: str, before: str, after: str) -> list[float]:
        b = np.frombuffer(candidate.encode(), dtype=np.uint8)
        kind = _CLASS[b]
        steps = np.bincount(kind[:-1] * 4 + kind[1:], minlength=16) / max(1, len(b) - 1)
        counts = np.bincount(b, minlength=256)
        p = counts[counts > 0] / len(b)
        pieces = re.findall(r"[A-Za-z]+", candidate)
        covered = sum(len(x) for x in pieces if x.lower() in self.words) / len(b)
        left, right = _neighbours(before, after)
        gap = before[len(before.rstrip(" \"'=:>")):]
        hexes = all(c in "0123456789abcdefABCDEF" for c in candidate)
        return [len(b), *steps, float(-(p * np.log2(p)).sum()), covered, max(map(len, pieces), default=0), float(hexes),
                candidate.count("/"), candidate.count("-") + candidate.count("_"), float(before[-1:] in ("/", ".", "\\")), float(after[:1] in ("/", ".", "\\", "@")),
                float("://" in before[-24:]), float("=" in gap or ":" in gap), float('"' in gap or "'" in gap),
                self.odds[0].get(left, 0.0), self.odds[1].get(right, 0.0), float(left in self.words), float(right in self.words)]


# --- forest ---------------------------------------------------------------------------------


class Forest:
    """Gini trees on bootstrap samples, each split over a random choice of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5):
        self.prior = float(y.mean()) if len(y) else 1.0
        self.trees: list[np.ndarray] = []
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        # Cuts are quantiles of all rows, so a split is one count per cut.
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, share
            self._grow(x[rows], y[rows], 0, nodes, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list, rng: np.random.Generator) -> int:
        me, share = len(nodes), float(y.mean())
        nodes.append([-1, 0, 0, 0, share])
        if depth == DEPTH or share in (0.0, 1.0) or len(y) < 2 * LEAST_LEAF:
            return me
        best, split = len(y) * share * (1 - share), None
        for j in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            cuts = self.cuts[j]
            place = np.searchsorted(cuts, x[:, j])
            n = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
            k = np.cumsum(np.bincount(place, weights=y, minlength=len(cuts) + 1))[:-1]
            ok = (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF)
            if ok.any():
                n, k, at = n[ok], k[ok], np.flatnonzero(ok)
                m, r = len(y) - n, y.sum() - k
                cost = k * (n - k) / n + r * (m - r) / m
                if cost.min() < best - 1e-12:
                    best, split = cost.min(), (int(j), float(cuts[at[cost.argmin()]]))
        if split:
            left = x[:, split[0]] <= split[1]
            lo = self._grow(x[left], y[left], depth + 1, nodes, rng)
            hi = self._grow(x[~left], y[~left], depth + 1, nodes, rng)
            nodes[me] = [split[0], split[1], lo, hi, share]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.prior)
        total, every = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = t[at, 0].astype(np.int64)
                down = np.where(x[every, f] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f >= 0, down, at)
            total += t[at, 4]
        return total / len(self.trees)


class Model:
    def __init__(self, rows: list[tuple[str, str, str]], labels: list[int]):
        y = np.array(labels, dtype=np.float64)
        self.vocabulary = Vocabulary(rows, y)
        self.forest = Forest(self.matrix(rows), y)

    def matrix(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([self.vocabulary.features(*r) for r in rows]) if rows else np.zeros((0, 1))

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return self.forest.predict(self.matrix(rows)) if rows else np.zeros(0)


def scan(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text",
         train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, start, length, candidate, score, is_secret) of all candidates. ``findings`` has
    candidate, before, after and secret (1 or 0); by default the documents' own, labelled by rules."""
    found = materialize(candidates(docs, key, text), "candidates")
    known = (label_findings(found) if findings is None else findings).filter(F.col("secret").isNotNull() & F.col("candidate").isNotNull())
    order = F.xxhash64("candidate", "before", "after")
    sample = known.filter(F.length("candidate") <= TRAIN_LENGTH).select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "secret").distinct()
    rows = sample.orderBy(order, "candidate", "before", "after", "secret").limit(train_rows).collect()
    model = docs.sparkSession.sparkContext.broadcast(Model([(r[0], r[1], r[2]) for r in rows], [r[3] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, b, a = (batch.column(i).to_pylist() for i in (2, 3, 4))
            score = model.value.scores(list(zip(c, b, a, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in c], pa.int64()), batch.column(2),
                 pa.array(score), pa.array(score >= threshold)], names=["key", "start", "length", "candidate", "score", "is_secret"])

    kinds = C.with_key(found, "start long, length long, candidate string, score double, is_secret boolean")
    return found.mapInArrow(run, kinds).withColumnRenamed("key", key)


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's score and verdict."""
    return scan(C.table(spark, sf_dir, "documents"))
