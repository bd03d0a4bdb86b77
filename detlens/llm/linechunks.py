"""Removal of repeated multi-line passages by content-defined line chunks. DataFrame functions only.

Lines that aren't blank are hashed, and those that occur twice or more in all documents are found. A run of such lines
in a document, with the blank lines between them, is a region: outside of regions nothing repeats. Rolling hashes over
the last ``WINDOW`` line hashes of the region cut it where they are smallest among ``REACH`` neighbours on either
side, so boundaries depend on nearby lines only and survive shifts, and every chunk has two lines or more. A chunk ends
before the next one or with its region's last line.

Chunks are compared over all documents: equal digests are candidates, and a chunk is removed if its bytes equal those of
the first occurrence (the smallest key, then the smallest digest of the text, then the first place in it), which
stays. A repeated passage that is a region in both documents is thus removed whole, from two lines on; where foreign
repeated lines adjoin it, a few lines at that end may stay. Texts take part in joins only where they have a region.

Digests are pre-aggregated before the shuffle; the joins read from tables, so that Spark can split a line or
a digest that many rows share.

Cases: null text has no lines and stays null; blank means nothing but U+0020; a text may become empty if all its
chunks are removed; a single repeated line stays; rows with equal keys and texts keep or lose the same chunks; a null
key is the first occurrence only if no other key has the chunk; rows that share a key, or have none, are told apart by
their texts. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.session import materialize

WINDOW = 2
#: A boundary is a minimum among so many rolling hashes before and after it.
REACH = 2


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text): ``row`` is a digest of the text, which tells rows of one key apart."""
    return docs.select(F.col(key).alias("key"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("row"), F.col(text).alias("text"))


def _lines() -> Column:
    return F.split("text", "\n")


def solid_lines(rows: DataFrame) -> DataFrame:
    """(key, row, ord, pos, line, x): the lines that aren't blank, numbered; ``line`` is a line's digest, x a number from it."""
    numbered = F.transform(_lines(), lambda line, i: F.struct(i.alias("pos"), line.alias("text")))
    solid = F.filter(numbered, lambda s: F.length(F.replace(s["text"], F.lit(" "), F.lit(""))) > 0)
    lines = rows.select("key", "row", F.posexplode(solid).alias("ord", "s")).withColumn("md5", F.md5(F.col("s.text").cast("binary")))
    return lines.select("key", "row", "ord", "s.pos", F.unhex("md5").alias("line"),
                        F.conv(F.substring("md5", 1, 8), 16, 10).cast("long").alias("x"))


def _is_cut(of: Window) -> Column:
    """Whether the chunk ends with this line: its rolling hash is the smallest around, and two lines are left on either side."""
    least = F.lit(True)
    for i in range(1, REACH + 1):
        least = least & F.coalesce(F.col("v") < F.lag("v", i).over(of), F.lit(True)) & F.coalesce(F.col("v") <= F.lead("v", i).over(of), F.lit(True))
    return least & F.lag("x", 1).over(of).isNotNull() & F.lead("x", 2).over(of).isNotNull()


def spans(lines: DataFrame) -> DataFrame:
    """(key, row, lo, hi): the chunks of two solid lines or more, as lines lo to hi of the text, from ``solid_lines``."""
    shared, n = C.counted(lines.groupBy("line").agg(F.count("*").alias("c")).filter("c > 1").select("line"), "shared-lines")
    again = lines.join(C.maybe_broadcast(shared, n, 32), "line").drop("line")
    again = again.groupBy("key", "row", "ord").agg(F.first("pos").alias("pos"), F.first("x").alias("x"))  # rows may repeat
    # Consecutive numbers are a region.
    doc = Window.partitionBy("key", "row").orderBy("ord")
    regions = again.withColumn("region", F.col("ord") - F.row_number().over(doc))
    of = Window.partitionBy("key", "row", "region").orderBy("ord")
    rolled = regions.withColumn("v", sum((F.coalesce(F.lag("x", j).over(of), F.lit(0)) * 31**j for j in range(1, WINDOW)), F.col("x")))
    cut = rolled.withColumn("cut", _is_cut(of).cast("int"))
    chunk = cut.withColumn("chunk", F.coalesce(F.sum("cut").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chunk = chunk.withColumn("next", F.lead("pos").over(of))
    parts = chunk.groupBy("key", "row", "region", "chunk").agg(
        F.min("pos").alias("lo"), F.max(F.coalesce(F.col("next") - 1, F.col("pos"))).alias("hi"), F.count("*").alias("full"))
    return parts.filter("full > 1").select("key", "row", "lo", "hi")


def repeated(chunks: DataFrame) -> DataFrame:
    """(key, row, lo, hi) of the chunks to remove, from (key, row, lo, hi, body)."""
    marked = materialize(chunks.withColumn("digest", F.unhex(F.md5(F.col("body").cast("binary")))), "chunks")
    place = F.struct(F.col("key").isNull().alias("unnamed"), "key", "row", "lo")
    shared, n_shared = C.counted(
        marked.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times"))
        .filter("times > 1").drop("times"), "digests")
    again = materialize(marked.join(C.maybe_broadcast(shared, n_shared, 96), "digest"), "repeated")
    here = place == F.col("first")
    first = materialize(again.filter(here).groupBy("digest").agg(F.min("body").alias("first_body")), "firsts")
    return again.join(first, "digest").filter(~here & (F.col("body") == F.col("first_body"))).select("key", "row", "lo", "hi")


def _with_spans(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``spans``, those of ``found`` (key, row, lo, hi) in order."""
    by_row = materialize(found.distinct().groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
                         .withColumnsRenamed({"key": "_key", "row": "_row"}), "row-spans")
    # The two sides of the join by a null key meet too: it is an ordinary key here. Spans grow with the documents, so both
    # sides are shuffled at any size; Spark splits a row that occurs often.
    on = F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row"))
    return rows.join(by_row.hint("merge"), on, how).drop("_key", "_row")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, removed_chunks, removed_lines, text) for every document."""
    rows = _rows(docs, key, text)
    lines = materialize(solid_lines(rows), "lines")
    chunks = _with_spans(rows, spans(lines), "inner").select("key", "row", _lines().alias("lines"), F.explode("spans").alias("s"))
    length = F.col("s.hi") - F.col("s.lo") + 1
    chunks = chunks.select("key", "row", "s.*", F.array_join(F.slice("lines", F.col("s.lo") + 1, length), "\n").alias("body"))
    out = _with_spans(rows, repeated(chunks), "left").withColumn("lines", _lines())
    # What is left lies between the removed spans.
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    gone = F.coalesce("spans", none)
    begin = lambda j: F.coalesce(F.get("spans", j - 1)["hi"] + 1, F.lit(0))
    end = lambda j: F.coalesce(F.get("spans", j)["lo"], F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda j: F.slice("lines", begin(j) + 1, end(j) - begin(j))))
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"] + 1)
    return out.select(F.col("key").alias(key), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                      F.size(gone).cast("long").alias("removed_chunks"), removed.alias("removed_lines"), kept.alias("text"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the multi-line chunks that an earlier document, or an earlier place, has."""
    return remove_repeats(C.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, text, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM d),
c AS (
  SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE replace(line, ' ', '') <> ''
  GROUP BY line HAVING count(*) > 1),
s AS (
  SELECT doc_id, text, pos, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS x, line IN (FROM c) AS again,
    row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS ord FROM u WHERE replace(line, ' ', '') <> ''),
g AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS region FROM s WHERE again),
v AS (SELECT *, x + 31 * coalesce(lag(x) OVER w, 0) AS v FROM g WINDOW w AS (PARTITION BY doc_id, text, region ORDER BY pos)),
e AS (
  SELECT *, lead(pos) OVER w AS nxt, coalesce(v < lag(v) OVER w, true) AND coalesce(v < lag(v, 2) OVER w, true) AND coalesce(v <= lead(v) OVER w, true)
    AND coalesce(v <= lead(v, 2) OVER w, true) AND lag(x) OVER w IS NOT NULL AND lead(x, 2) OVER w IS NOT NULL AS cut
  FROM v WINDOW w AS (PARTITION BY doc_id, text, region ORDER BY pos)),
n AS (
  SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id, text, region ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
k AS (
  SELECT doc_id, text, min(pos) AS lo, max(coalesce(nxt - 1, pos)) AS hi FROM n GROUP BY doc_id, text, region, chunk HAVING count(*) > 1),
b AS (SELECT *, array_to_string(string_split(text, chr(10))[lo + 1:hi + 1], chr(10)) AS body FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, md5(text), lo) AS nth FROM b),
m AS (SELECT doc_id, text, count(*) AS removed_chunks, sum(hi - lo + 1) AS removed_lines FROM r WHERE nth > 1 GROUP BY 1, 2),
t AS (
  SELECT u.doc_id, u.text, string_agg(line, chr(10) ORDER BY pos) FILTER (r.doc_id IS NULL) AS kept
  FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.text = u.text AND nth > 1 AND pos BETWEEN lo AND hi GROUP BY 1, 2)
SELECT documents.doc_id, coalesce(len(string_split(documents.text, chr(10))), 0) AS n_lines, coalesce(removed_chunks, 0) AS removed_chunks,
  CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents LEFT JOIN m ON m.doc_id = documents.doc_id AND m.text = documents.text
  LEFT JOIN t ON t.doc_id = documents.doc_id AND t.text = documents.text
"""
