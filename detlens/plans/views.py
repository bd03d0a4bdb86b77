"""Inputs derived from the driver tables, as Spark DataFrames.

Tokens and their neighbours are computed inside the row that holds the document
(array functions over the word array), so next / previous word and the +-5 word
context need no window and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.labels import format_benchmark, label_wide_pass
from detlens.functions.replies import predict

WORD_PATTERN = r"\p{L}+"
CONTEXT_WORDS = 5
ITEM_DETERMINERS = ("the", "a", "an")
N_TEMPLATES = len(K.REPLY_TEMPLATES)
RUNS = K.DEFAULT_RUNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: partitions that document scans are dealt into. 0, the default, leaves the number of
#: splits to the reader; a local run over a file of one row group wants a few per core.
SCAN_PARTITIONS = "detlens.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan into ``detlens.scan.partitions`` partitions, if that is set."""
    n = int(df.sparkSession.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(n) if n else df


def document_words(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """(doc_id, source, words): documents of one or all languages as lower-cased letter runs."""
    docs = table(spark, sf_dir, "documents")
    if lang:
        docs = docs.filter(F.col("lang") == lang)
    return spread(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), 0).alias("words"))


def english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents: determiner items and the detector are about English."""
    return document_words(spark, sf_dir, "en")


def tokens(words: DataFrame) -> DataFrame:
    """View ``tok``: (doc_id, pos, w)."""
    return words.select("doc_id", F.posexplode("words").alias("pos", "w")).withColumn("pos", F.col("pos").cast("bigint"))


def tokens_ctx(words: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, pos, w, p, n): every token with previous and next word."""
    ws = F.col("words")
    return words.select(
        "doc_id",
        "source",
        F.size(ws).cast("bigint").alias("n_words"),
        F.inline(
            F.transform(
                ws,
                lambda x, i: F.struct(
                    i.cast("bigint").alias("pos"), x.alias("w"),
                    F.get(ws, i - 1).alias("p"), F.get(ws, i + 1).alias("n"),
                ),
            )
        ),
    )


def np_items(words: DataFrame) -> DataFrame:
    """View ``np_items``: determiner + lower-case next word, with the +-5 word sentence."""
    ws = F.col("words")
    n_words = F.size(ws)

    def item(x, i):
        nxt = F.get(ws, i + 1)
        lo = F.greatest(i - CONTEXT_WORDS, F.lit(0))
        hi = F.least(i + CONTEXT_WORDS, n_words - 1)
        is_item = x.isin(*ITEM_DETERMINERS) & nxt.rlike(r"\A[a-z]+\z")
        # Few words are items; the others make no struct.
        return F.when(is_item, F.struct(
            i.cast("bigint").alias("pos"), x.alias("w"), nxt.alias("n"),
            F.array_join(F.slice(ws, lo + 1, hi - lo + 1), " ").alias("sentence"),
        ))

    items = words.select("doc_id", "source", F.inline(F.filter(F.transform(ws, item), lambda s: s.isNotNull())))
    alt = F.concat(F.when(F.col("w") == "the", F.lit("a")).otherwise(F.lit("the")), F.lit(" "), F.col("n"))
    k = (F.col("doc_id") + F.col("pos")) % 4
    gold_fix = (
        F.when(k == 0, F.col("n")).when(k == 1, alt).when(k == 2, F.lit("")).otherwise(F.lit("NaN"))
    )
    return items.select(
        "doc_id", "source", "pos", "w", "n", "sentence",
        F.concat(F.col("w"), F.lit(" "), F.col("n")).alias("noun_phrase"),
        alt.alias("alt"),
        gold_fix.alias("gold_fix"),
    )


def benchmark_table(words: DataFrame) -> DataFrame:
    """P6 over ``np_items``: (doc_id, source, pos, alt, sentence, noun_phrase, grammatical, corrected)."""
    return format_benchmark(np_items(words), keep=("doc_id", "source", "pos", "alt"))


def _render(template: str, noun_phrase: Column, alt: Column) -> Column:
    parts = [p for p in re.split(r"(\{np\}|\{alt\})", template) if p != ""]
    if not parts:
        return F.lit("")
    cols = [noun_phrase if p == "{np}" else alt if p == "{alt}" else F.lit(p) for p in parts]
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def template_index(doc_id="doc_id", pos="pos") -> Column:
    return (F.col(doc_id) * 31 + F.col(pos)) % N_TEMPLATES


def template_reply(noun_phrase="noun_phrase", alt="alt") -> Column:
    """The default scorer as a native expression: one golden template per row key."""
    idx = template_index()
    out = None
    for i, tpl in enumerate(K.REPLY_TEMPLATES):
        val = _render(tpl, F.col(noun_phrase), F.col(alt))
        out = F.when(idx == i, val) if out is None else out.when(idx == i, val)
    return out


def replies(words: DataFrame) -> DataFrame:
    """View ``replies``: benchmark rows + the default scorer's reply."""
    return benchmark_table(words).withColumn("reply", template_reply())


def preds(words: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """View ``preds``: replies through P7-P11; the six prediction columns plus keys."""
    scored = scored if scored is not None else replies(words)
    out = predict(scored)
    return out.select(
        "doc_id", "source", "pos", "sentence", "noun_phrase",
        label_wide_pass("grammatical").alias("grammatical"),
        "corrected", "grammatical_pred", "correction", "fix_pred",
    )


def run_columns(source="source", pos="pos") -> list[Column]:
    """script / model / input / run for the repeated-runs views."""
    s = F.col(source)
    return [
        F.concat(F.lit("job_"), s, F.lit(".sh")).alias("script"),
        F.concat(F.lit("org/model-"), s).alias("model"),
        F.concat(s, F.lit(".csv")).alias("input"),
        (F.col(pos) % RUNS + 1).cast("bigint").alias("run"),
    ]


def runs(words: DataFrame) -> DataFrame:
    """View ``runs``: predictions labelled with script / model / input / run."""
    p = preds(words)
    return p.select(*run_columns(), *[c for c in p.columns])


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``lab``: labels joined to documents; gold = quality, prediction = n_chars > 500."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id", "source",
        F.col("quality").cast("string").alias("grammatical"),
        F.when(F.col("n_chars") > 500, F.lit("1")).otherwise(F.lit("0")).alias("grammatical_pred"),
    )
