"""Scoring that can be taken up again (L0): a ledger of committed batches of rows.

Rows are named by a digest of their key columns. A call takes the rows that no committed batch holds, deals
them into batches by that digest, and scores and writes one batch after the other, each as one Spark job on
all executors. A batch counts once Spark has committed its folder, so a run that is killed at any point goes
on with the batches that are missing and asks the scorer about no committed row again; rows that are new to the input
are taken up, too. Within a batch, what a lost task had scored is scored again.

Cases: rows with equal keys are one batch's and are all scored; a null is a key like any other; no rows
make no batch; a folder without a commit mark is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detlens.operators.scoring import batch_score
from detlens.session import materialize

#: Batches that a call deals its rows into.
BATCHES = 16
ROW_ID = "_row_id"


def _committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of the committed batches, from one listing."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(f.getPath().getParent().getName() for f in found)


def drop(spark: SparkSession, folder: str) -> None:
    """Forget all batches of ``folder``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def committed_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    paths = [f"{folder}/{name}" for name in _committed(spark, folder)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def score_once(df: DataFrame, factory: Callable[[], object], folder: str, keys, out_col: str = "reply", seed: int = 0,
               batches: int = BATCHES) -> DataFrame:
    """``df`` with ``out_col`` from ``factory().score(batch, seed)``, kept under ``folder``; rows that are there already
    are not scored again. ``keys`` name a row."""
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType(), True), T.StructField(ROW_ID, T.BinaryType(), True)])
    named = df.withColumn(ROW_ID, F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).cast("binary"))))
    done = committed_rows(spark, folder, schema)
    pending = named.join(done.select(ROW_ID), ROW_ID, "left_anti").select(named.columns)
    batch = F.pmod(F.xxhash64(ROW_ID), F.lit(batches)).cast("int")
    # Written once: batches read their own rows only, and what was begun is the same rows if a later batch fails.
    dealt = materialize(pending.withColumn("_batch", batch).repartition("_batch", ROW_ID), "pending", partition_by="_batch")
    sizes = {r["_batch"] for r in dealt.groupBy("_batch").count().collect()}  # at most ``batches`` rows
    first = 1 + max([int(n.partition("=")[2]) for n in _committed(spark, folder)], default=-1)
    for i, b in enumerate(sorted(sizes)):
        rows = dealt.filter(F.col("_batch") == b).select(named.columns)
        scored = batch_score(rows, factory, out_col, seed).select([f.name for f in schema.fields])
        scored.write.mode("overwrite").parquet(f"{folder}/batch={first + i}")
    return committed_rows(spark, folder, schema).drop(ROW_ID)
