"""Quality rules per document and verdicts per host.

Every document is measured and held against the base rules. Failures are counted by domain, and
each domain's failure rate is shrunk towards a beta prior that is fitted to all domains (method
of moments), so that a domain of few documents is not judged by chance. A domain whose shrunk
rate exceeds ``MAX_RATE`` is rejected with all its documents.

The domain of ``documents`` is its ``source``. Documents without a domain (null) are counted by
none and judged by the base rules only.

Cases: null text has no words and fails; repeated rows count as often as they occur; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens.llm import common as C
from detlens.session import materialize

#: A domain is rejected if more than this share of its documents fails, after shrinking.
MAX_RATE = 0.8
MIN_WORDS = 50
#: Per cent of the words that may lie in repeated three-word windows.
MAX_REPEATED = 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SUMS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(flags: np.ndarray, texts: C.Texts) -> np.ndarray:
    """How many flagged bytes each text has."""
    run = np.append(0, np.cumsum(flags, dtype=np.int64))
    return run[texts.hi] - run[texts.lo]


def _again(doc: np.ndarray, value: np.ndarray, ever: bool) -> np.ndarray:
    """Which entries equal an earlier entry of their text (``ever``: any other entry)."""
    order = np.lexsort((np.arange(len(value)), value, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(value), dtype=bool)
    out[order[1:][same]] = True
    if ever:
        out[order[:-1][same]] = True
    return out


def measure_texts(texts: C.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    w = C.Words(texts, C.SPACED)
    hashes = C.span_hashes(texts.data, w.start, w.end)
    lead = (texts.data & 0xC0) != 0x80
    chars = _per_text(lead & C.SPACED[texts.data], texts)
    symbols = _per_text(_SYMBOL[texts.data], texts)

    # Lines are the spans between newlines and the ends of the texts.
    newline = np.flatnonzero(texts.data == 0x0A)
    lo = np.concatenate([texts.lo, newline + 1])
    hi = np.concatenate([newline, texts.hi])
    doc = np.searchsorted(texts.hi, newline, side="right")
    lo_doc = np.concatenate([np.arange(len(texts)), doc])
    order = np.lexsort((lo, lo_doc))
    lo, line_doc = lo[order], lo_doc[order]
    hi = hi[np.lexsort((hi, np.concatenate([doc, np.arange(len(texts))])))]
    has_word = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
    lo, hi, line_doc = lo[has_word], hi[has_word], line_doc[has_word]
    lines = C.span_hashes(texts.data, lo, hi)
    dup_lines = np.bincount(line_doc[_again(line_doc, lines, False)], minlength=len(texts))

    windows, at = C.shingle_hashes(hashes, w.doc, 3)
    at = at[_again(w.doc[at], windows, True)]
    repeated = np.zeros(len(w) + 2, dtype=bool)
    for i in range(3):
        repeated[at + i] = True
    repeats = np.bincount(w.doc[repeated[: len(w)]], minlength=len(texts))
    return [w.count, chars, symbols, dup_lines, repeats]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: Column | str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per document."""
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(F.col(key).alias("key"), host.cast("string").alias("host"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in C.slices(batch.column(2)):
                sums = [pa.array(x.astype(np.int64)) for x in measure_texts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *sums],
                    names=["key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return rows.mapInArrow(run, C.with_key(rows, f"host string, {_SUMS}"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failed, host_rate, host_ok): failure rates shrunk by the beta prior of all hosts.

    The prior's strength follows from the rates' variance beyond binomial noise. If they vary no
    more than chance would have it, the hosts are alike and every rate is the overall mean.
    """
    hosts = materialize(
        measured.filter(F.col("host").isNotNull()).groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    s = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("h"),
                  F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("ff"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    alpha, beta, pooled = beta_prior(s["n"] or 0, s["f"] or 0, s["h"], s["ff"] or 0.0, s["nn"] or 0.0)
    rate = F.lit(pooled) if alpha is None else (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    return hosts.withColumn("host_rate", rate.cast("double")).withColumn("host_ok", F.col("host_rate") <= max_rate)


def beta_prior(n: int, failed: int, hosts: int, ff: float, nn: float) -> tuple[float | None, float | None, float]:
    """(alpha, beta, mean rate) from sums over hosts: n, failed, failed**2 / n and n**2.
    alpha and beta are None where the rates vary no more than binomial noise."""
    if not n:
        return None, None, 0.0
    mean = failed / n
    between = n - nn / n
    variance = (ff - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / between if between > 0 else 0.0
    if mean in (0.0, 1.0) or variance <= 0:
        return None, None, mean
    strength = max(mean * (1 - mean) / variance - 1, 1e-6)
    return mean * strength, (1 - mean) * strength, mean


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: Column | str = "source",
                max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of every document with base_failed, host_rate and ``kept``."""
    measured = materialize(measure(docs, key, text, host).withColumn("base_failed", base_failed()), "measured")
    hosts, n = C.counted(host_verdicts(measured, max_rate).select("host", "host_rate", "host_ok"), "verdicts")
    return (measured.join(C.maybe_broadcast(hosts, n), "host", "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))
            .withColumnRenamed("key", key))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts for every document."""
    return apply_rules(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
l AS (
  SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x{20}\x{09}-\x{0D}]') GROUP BY 1, 2) GROUP BY 1),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k FROM f WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS h, sum(k * k / n) AS kk, sum(CAST(n AS DOUBLE) * n) AS nn, sum(k) / sum(n) AS mu FROM h),
v AS (SELECT *, CASE WHEN n - nn / n > 0 THEN (kk - n * mu * mu - (h - 1) * mu * (1 - mu)) / (n - nn / n) ELSE 0 END AS var FROM s),
p AS (SELECT *, CASE WHEN mu IN (0, 1) OR var <= 0 THEN NULL ELSE greatest(mu * (1 - mu) / var - 1, 1e-6) END AS strength FROM v),
q AS (
  SELECT source, CASE WHEN strength IS NULL THEN mu ELSE (h.k + mu * strength) / (h.n + strength) END AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_rate <= 0.8, true) AS kept, host_rate
FROM f LEFT JOIN q USING (source)
"""
