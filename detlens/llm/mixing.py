"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. A source is taken whole as often as its target
allows (complete epochs); the rest is a weighted sample without replacement: each document
draws the exponential key -ln(u) / quality, keys are sorted within the source, and documents
are taken while the running sum of words stays nearest to the rest. u comes from a digest of the
document's id, so reruns agree.

Sorting a source in one task would put a hot source into one task. Keys are therefore dealt
into about sqrt(n) ranges of a source's n documents: one window adds up the ranges' totals,
another one the documents of a range, so either holds about sqrt(n) rows.

Cases: null text has size 0 and takes no words; a null source is a source of its own, last in
order; a document without an id draws by its text; repeated rows are taken like any other rows (equal rows
are interchangeable); with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.session import materialize

SEED = "mix-1"
#: No source, and so no document, is taken more often.
MAX_EPOCHS = 3
#: Quality weights: a labelled good document draws as if it were there twice.
GOOD, UNKNOWN, POOR = 2.0, 1.5, 1.0


def ordinal(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``ordinal`` 0, 1, ... in the given order, without one task for all rows: ranges
    are sorted apart, and only the number of rows of each range passes the driver."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (placed.withColumn("_nth", nth).join(F.broadcast(offsets), "_range")
            .withColumn("ordinal", F.col("_before") + F.col("_nth") - 1).drop("_range", "_before", "_nth"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size, n): weights by the sources' order, no more than
    ``max_epochs`` times a source's size, and the excess reshared by weight until none is above."""
    nth = F.col("ordinal") % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth + 1).cast("int"))
    ranked = materialize(ordinal(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight), "sources")
    most = F.lit(float(max_epochs)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words = share * float(total["words"] or 0)
    level = words / total["weight"] if total["weight"] else 0.0
    while words:
        full = most <= F.lit(level) * F.col("weight")
        s = ranked.agg(F.sum(F.when(full, most)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        raised = (words - (s["full"] or 0.0)) / s["weight"] if s["weight"] else level
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("ordinal")


def quality_weights(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(key, quality) from labels: the mean of a document's labels between POOR and GOOD."""
    return labels.groupBy(F.col(key).alias("key")).agg((POOR + (GOOD - POOR) * F.avg(quality)).alias("quality"))


def mix(docs: DataFrame, quality: DataFrame | None = None, key: str = "doc_id", text: str = "text",
        source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(key, source, text_hash, size, source_size, target, copies, taken) for every row of ``docs``."""
    sized = materialize(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.regexp_count(text, F.lit(C.SPACED_PATTERN)), F.lit(0)).cast("long").alias("size")), "sized")
    sources, n = C.counted(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights,
                max_epochs=max_epochs), "targets")
    if quality is not None:
        q = quality.select(F.col("key").alias("_key"), "quality")
        sized = sized.join(q, F.col("key") == F.col("_key"), "left").drop("_key")
    else:
        sized = sized.withColumn("quality", F.lit(None).cast("double"))
    name = F.concat(F.lit(SEED + "/"), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("text/"), F.col("text_hash").cast("string"))))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = sized.withColumn("draw", -F.log(u) / F.coalesce("quality", F.lit(UNKNOWN)))

    s = sources.select(F.col("source").alias("_source"), "source_size", "n", "target")
    placed = (drawn.join(C.maybe_broadcast(s, n), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
              .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
              .withColumn("range", F.floor((1 - F.exp(-F.col("draw"))) * F.ceil(F.sqrt("n")))))
    placed = materialize(placed.drop("n", "quality"), "drawn")
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
                         .select(F.col("source").alias("_source"), F.col("range").alias("_range"), "before"), "ranges")
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))
    inner = (Window.partitionBy("source", "range").orderBy("draw", "key", "size", "text_hash")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = F.col("before") + F.sum("size").over(inner)
    chosen = (run - F.col("size") / 2) < F.col("rest")
    return (placed.join(ranges, on).withColumn("copies", F.col("epochs") + chosen.cast("long"))
            .select(F.col("key").alias(key), "source", "text_hash", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to source weights 1, 2, 3; labelled quality raises a document's chance."""
    mixed = mix(C.table(spark, sf_dir, "documents"), quality_weights(C.table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
-- Sources reach their limit in the order of size over weight; the level is the first at which the next one does not.
o AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w),
l AS (SELECT arg_min((total - capped) / free, nth) AS level FROM o WHERE 3.0 * source_size > (total - capped) / free * weight),
t AS (SELECT source, source_size, least(3.0 * source_size, coalesce(level, 0) * weight) AS target FROM w, l),
q AS (SELECT doc_id, 1.0 + avg(quality) AS quality FROM labels GROUP BY 1),
k AS (
  SELECT d.doc_id, d.source, d.size, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    -ln((CAST('0x' || substr(md5('mix-1/' || d.doc_id), 1, 13) AS BIGINT) + 0.5) / CAST(1::BIGINT << 52 AS DOUBLE)) / coalesce(quality, 1.5) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.doc_id = q.doc_id),
c AS (
  SELECT *, epochs + CASE WHEN sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0
    < target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""
