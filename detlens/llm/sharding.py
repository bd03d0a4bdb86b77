"""Shards by rendezvous hashing of stable record keys. DataFrame functions only.

Every shard draws a number for every key: u in (0, 1) from a digest of (seed, shard name, key),
scored -ln(u) / weight. The smallest score wins, so a shard gets a share of the keys in proportion
to its weight, and neither the order nor the number of the other shards enters its draw. A new
shard can therefore only take keys into itself, and a shard that leaves gives up only its own.

Within a shard rows are numbered by (key, size, checksum) without one task for a shard: the small
table of placed rows is sorted by ranges that also break ties by row, so a shard, or a key that
many rows share, may span many ranges. A row's slot is its place in its range, less the shard's
first place there, plus the shard's rows in earlier ranges. Texts never travel.

Cases: null text has no bytes, size 1 and checksum 0, as an empty one; a null key is a key of its
own, apart from an empty one; rows of one key share a shard and get slots of their own, where
equal rows are interchangeable; a shard without keys has no rows; an empty table gives an empty
result; extra columns are not read. Two shards of one name, no shards, or a weight that is not
above 0 are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detlens.llm import common as C
from detlens.session import materialize

SEED = "shard-1"
#: (name, weight): the query's eight shards, and the one that may come next.
SHARDS = tuple((str(i), 1.0) for i in range(8))
NEXT = ("8", 1.0)


def scores(key: str | Column, shards: tuple[tuple[str, float], ...], seed: str = SEED) -> list[Column]:
    """The score of every shard for a key; 52 bits of a digest make u, so it is never 0 or 1."""
    key = F.col(key) if isinstance(key, str) else key
    name = F.coalesce(F.concat(F.lit("/"), key.cast("string")), F.lit(""))
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{s}"), name).cast("binary")), 1, 13), 16, 10).cast("long")
    return [-F.log((draw(n) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(w)) for n, w in shards]


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within ``group``, in the given order.

    ``rows`` should come from a table. Rows that tie in all of ``order`` are told apart by their
    place in it, so that any number of them may be split over ranges."""
    n = F.monotonically_increasing_id()
    # Ids restart at a multiple of 2^33 in every partition and follow the sorted order in it.
    placed = materialize(
        rows.withColumn("_tie", n).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
        .drop("_tie").withColumn("_range", F.spark_partition_id()).withColumn("_at", n.bitwiseAND((1 << 33) - 1)), "ranges")
    # One row for each range, and one more for each group that ends in it.
    parts = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts, n_parts = C.counted(
        parts.select(F.col(group).alias("_group"), F.col("_range").alias("_part"),
                     (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")),
        "range-offsets")
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part"))
    return (placed.join(C.maybe_broadcast(parts, n_parts), on)
            .withColumn("slot", F.col("_at") + F.col("_shift")).drop("_group", "_part", "_shift", "_range", "_at"))


def place(docs: DataFrame, shards: tuple[tuple[str, float], ...] = SHARDS, grown: tuple[str, float] | None = NEXT,
          key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row; ``grown_shard`` is where the
    row would go with the shard ``grown`` beside the others (null if none is given)."""
    every = shards + ((grown,) if grown else ())
    if not shards or len({name for name, _ in every}) < len(every) or any(weight <= 0 for _, weight in every):
        raise ValueError("shards need distinct names and weights above 0")
    rows = docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"))
    rows = rows.withColumn("draws", F.array(*scores("key", every, seed)))
    first = F.slice("draws", 1, len(shards))
    winner = lambda draws: (F.array_position(draws, F.array_min(draws)) - 1).cast("int")
    rows = rows.withColumn("shard", winner(first)).withColumn("grown_shard", winner(F.col("draws")) if grown else F.lit(None).cast("int"))
    rows = numbered(materialize(rows.drop("draws"), "placed"), "shard", "key", "size", "text_crc32")
    return rows.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")


def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight equal shards by their id, and where they would go with a ninth."""
    return place(C.table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


def _crc_bit(i: int) -> int:
    """What bit i of a byte adds to the CRC-32 of that byte."""
    c = 1 << i
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


def crc32_sql(blob: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a blob: bits are added one by one, as it is linear."""
    added = "0"
    for i in range(8):
        added = f"xor({added}, ((xor(c, b) >> {i}) & 1) * {_crc_bit(i)})"
    return (f"xor(list_reduce(list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT)), "
            f"lambda c, b: xor(c >> 8, {added}), CAST(4294967295 AS BIGINT)), 4294967295)")


_SCORES = ", ".join(f"-ln((CAST('0x' || substr(md5('{SEED}/{n}' || coalesce('/' || doc_id, '')), 1, 13) AS BIGINT) + 0.5)"
                    f" / CAST(1::BIGINT << 52 AS DOUBLE)) / {w}" for n, w in (*SHARDS, NEXT))
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    CAST({crc32_sql("encode(coalesce(text, ''))")} AS BIGINT) AS text_crc32, [{_SCORES}] AS s FROM documents),
p AS (
  SELECT doc_id, size, text_crc32, CAST(list_position(s[1:8], list_min(s[1:8])) - 1 AS INT) AS shard,
    CAST(list_position(s, list_min(s)) - 1 AS INT) AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM p
"""
