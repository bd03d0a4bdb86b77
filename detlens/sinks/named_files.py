"""Files under derived names (K2, K5): one file for each artefact, as other tools expect them.

Spark names its part files itself. So the rows of all files are written once, dealt by file, into a staging folder
below the target, a manifest table is made of what was staged (staged path, name, bytes), and the commit step renames
each staged file to its name, which costs metadata only, as in Spark's own committer. The manifest is written first:
``commit`` may be called again after a failure at any point and does what is left. Readers that go by the manifest see
complete files only.

A file has one writer, which streams its rows (sorted rows spill); files are written in parallel.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.text import artifact_key, basename, safe_name
from detlens.operators.runs import RUN_KEYS, per_run_metrics
from detlens.sinks.writers import MINIMAL_OPTIONS, nested_result, run_info, stored_runs
from detlens.sources.csv_splits import one_scheme

MANIFEST = "_manifest"


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_named(df: DataFrame, file: Column, folder: str, columns, order=(), text: bool = False) -> DataFrame:
    """Write the rows of ``df`` into the files that ``file`` names below ``folder``: the ``columns`` as CSV with a header
    or, with ``text``, the lines of the only one. ``order`` sorts a file's rows. Returns the manifest (staged, name, bytes)."""
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    named = df.withColumn("_file", file).repartition("_file").sortWithinPartitions("_file", *order)
    writer = named.select("_file", *columns).write.partitionBy("_file")
    writer.text(f"{staging}/files") if text else writer.options(**{**MINIMAL_OPTIONS, "emptyValue": '""'}).csv(f"{staging}/files")
    staged = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{staging}/files")
              .select(one_scheme(F.col("path")).alias("staged"), F.col("length").alias("bytes")))
    # Partition values are in the paths, special characters as %XX.
    value = F.replace(F.regexp_extract("staged", r"/_file=([^/]*)/[^/]*\z", 1), F.lit("+"), F.lit("%2B"))
    staged.select("staged", F.url_decode(value).alias("name"), "bytes").write.parquet(f"{staging}/{MANIFEST}")
    return commit(spark, folder, staging)


def commit(spark: SparkSession, folder: str, staging: str) -> DataFrame:
    """Give the staged files their names; a name that is there already is replaced. Returns the manifest."""
    path, fs = _hadoop(spark, folder)
    manifest = spark.read.parquet(f"{staging}/{MANIFEST}")
    for r in manifest.select("staged", "name").toLocalIterator():
        staged, target = path(r["staged"]), path(f"{folder.rstrip('/')}/{r['name']}")
        if not fs.exists(staged):
            if fs.exists(target):
                continue  # done by an earlier call
            raise FileNotFoundError(r["staged"])
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(staged, target):
            raise OSError(f"could not rename {r['staged']} to {r['name']}")
    kept = f"{folder.rstrip('/')}/{MANIFEST}/{staging.rpartition('/')[2]}"
    manifest.write.mode("overwrite").parquet(kept)
    fs.delete(path(f"{staging}/files"), True)  # empty folders and Spark's mark
    return spark.read.parquet(kept)


def write_prediction_files(preds: DataFrame, folder: str, order=()) -> DataFrame:
    """K2: ``model__input__predictions.csv`` with the six columns, for every model and input."""
    return write_named(preds, artifact_key("model", "input"), folder, K.PREDICTION_TABLE_COLUMNS, order)


def run_folder() -> Column:
    """``script/model__input/run_01``: where a run's files lie in a session."""
    stem = F.regexp_replace("script", r"(.)\.[^.]*\z", "$1")
    number = F.col("run").cast("string")
    return F.concat_ws("/", stem, F.concat(safe_name("model"), F.lit("__"), basename("input")),
                       F.concat(F.lit("run_"), F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0"))))


def write_run_files(runs: DataFrame, folder: str, session: str, order=(), **about) -> DataFrame:
    """K5: each run's predictions, ``metrics.json`` and ``run_info.json`` under
    ``folder/session/script/model__input/run_NN``; ``about`` as for ``writers.run_info``. Returns the manifest of all files."""
    at = lambda name: F.concat(F.lit(f"{session}/"), run_folder(), F.lit("/"), name)
    line = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line")
    runs = stored_runs(runs)
    preds = write_named(runs, at(artifact_key("model", "input")), folder, K.PREDICTION_TABLE_COLUMNS, order)
    metrics = per_run_metrics(runs).select(at(F.lit("metrics.json")).alias("name"), line(*nested_result()))
    known = runs.select(*RUN_KEYS, "run").distinct()
    info = known.select(at(F.lit("run_info.json")).alias("name"), line(*run_info(**about)))
    return preds.unionByName(write_named(metrics.unionByName(info), F.col("name"), folder, ["line"], text=True))
