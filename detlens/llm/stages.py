"""The pipeline's stages: each applies one operator's decisions to the documents it is given.

All but the last return the columns of their input. Decisions that need nothing but the row are
made on whole rows packed as a key, without a join; extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.llm import contamination, mixing, neardup, tokens, toxicity
from detlens.session import shared_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic. Texts without words score 0 and stay; repeated rows share a fate; without
    labels of both kinds every text with words scores the share of toxic labels."""
    network = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    return toxicity.score(C.packed(docs), network).filter(F.col("score") < toxicity.THRESHOLD).select("key.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, whatever its id.

    Documents are told apart by id and text, so several texts of one id, or of none, are judged each by
    itself; of rows with equal id and text one stays."""
    rows = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).alias("_document"),
                       F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = neardup.near_duplicates(rows.select("_document", F.col("row.text").alias("text")), key="_document")
    kept = found.filter("kept").select("_document").distinct()
    # Equal rows are pre-aggregated before the shuffle, which serves the join as well.
    return rows.groupBy("_document").agg(F.first("row").alias("row")).join(kept, "_document", "left_semi").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the benchmark contaminates. Texts without words, and all texts if the benchmark is empty,
    stay; repeated rows share a fate."""
    found = contamination.scan(C.packed(docs), C.table(spark, sf_dir, "benchmark"), key="key")
    return contamination.decide(found).filter(~F.col("contaminated")).select("key.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix does. Rows of equal key, source and text share their
    copies evenly."""
    mixed = mixing.mix(docs, mixing.quality_weights(C.table(spark, sf_dir, "labels")))
    keys = {"doc_id": "_key", "source": "_source", "text_hash": "_text"}
    copies = (mixed.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
              .filter("_copies > 0").withColumnsRenamed(keys))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("k"),
                       F.col("source").alias("s"), F.xxhash64("text").alias("t"))
    on = F.col("k").eqNullSafe(F.col("_key")) & F.col("s").eqNullSafe(F.col("_source")) & (F.col("t") == F.col("_text"))
    nth = F.row_number().over(Window.partitionBy("k", "s", "t").orderBy("t"))
    times = F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("long")
    taken = rows.join(copies, on).withColumn("times", times).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token-id files and return what they hold: (doc_id, start, n_tokens, ids_crc32), a row for every document; a
    null or empty text is its end id alone, an empty table has no files and gives no rows."""
    manifest = tokens.write(docs, shared_path(spark, "tokens"), tokens.tokenizer_path())
    return tokens.read(manifest, manifest.count(), ids=False)
