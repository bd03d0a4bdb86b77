"""Metrics as prediction files arrive and are replaced (ST1), with a limit on waiting for them.

A predictions file is a table partition (script / model / input / run) of the source folder. It counts in its
last version only, as the scorer writes the file of a run anew:

* ``poll`` lists the folder, compares every file's time and size with what was seen before, reads the
  files that are new or newer, and appends a row for each (counts, or the error that it can't be read) to the table
  of arrivals. Spark's own file stream would pass over a file whose path it has seen.
* ``start_run_metrics`` streams the arrivals through a stateful processor with one state per run: the counts of each of
  its files by version. A newer version takes the place of the old one's counts, an older one is ignored.
* ``expect`` announces launched runs. A run whose predictions have not come within the limit gets an error row from a
  processing-time timer; it is replaced when they come after all.

Every epoch publishes a version of the small table of runs; readers take the last complete one, ratios are
derived on read, and all but the last two versions are dropped.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from detlens import constants as K
from detlens.operators.metrics import confusion_columns, prf_accuracy
from detlens.session import materialize, shared_path
from detlens.sources import files as SRC
from detlens.sources.csv_splits import one_scheme

RUN_KEY = ("script", "model", "input", "run")
COUNTS = ("tp", "fp", "fn", "tn")


def _schema(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "n": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in columns.items()])


_RUN = {"script": "s", "model": "s", "input": "s", "run": "n"}
_COUNTS = dict.fromkeys(COUNTS, "n")
ARRIVALS = _schema(**_RUN, kind="s", file="s", version="n", bytes="n", **_COUNTS, error="s")
RUNS = _schema(**_RUN, **_COUNTS, n_total="n", error="s")
#: Changed files are read by name up to so many; beyond that the folder is read and joined with them.
NAMED_FILES = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run_columns(file: str) -> list[Column]:
    """The run that a table partition's path names; Spark writes special characters of a value as %XX."""

    def value(name: str) -> Column:
        raw = F.regexp_extract(file, rf"/{name}=([^/]*)", 1)
        return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)

    return [value(c).alias(c) if c != "run" else F.try_to_number(value(c), F.lit("999999999999")).cast("long").alias(c) for c in RUN_KEY]


def _listing(spark: SparkSession, source: str) -> DataFrame:
    """(file, path, version, bytes) of every part file, with the predictions file that it is a part of."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    except AnalysisException:  # the folder doesn't exist yet, or is empty
        return spark.createDataFrame([], "file string, path string, version long, bytes long")
    parts = found.select(one_scheme(F.col("path")).alias("path"), F.unix_millis("modificationTime").alias("version"), F.col("length").alias("bytes"))
    return parts.select(SRC.logical_file("path").alias("file"), "path", "version", "bytes")


def seen(spark: SparkSession, arrivals: str) -> DataFrame:
    try:
        return spark.read.schema(ARRIVALS).parquet(arrivals)
    except AnalysisException:
        return spark.createDataFrame([], ARRIVALS)


def poll(spark: SparkSession, source: str, arrivals: str) -> int:
    """Append a row to ``arrivals`` for every predictions file under ``source`` that is new or was replaced; returns how many."""
    parts = materialize(_listing(spark, source), "listing")
    now = parts.groupBy("file").agg(F.max("version").alias("version"), F.sum("bytes").alias("bytes"))
    known = seen(spark, arrivals).filter("kind = 'counts'").select("file", "version", "bytes").distinct()
    changed = materialize(now.join(known, ["file", "version", "bytes"], "left_anti"), "changed")
    n = changed.count()
    if n:
        paths = parts.join(changed.select("file"), "file", "left_semi").select("path")
        few = paths.limit(NAMED_FILES + 1).collect()
        escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in few]
        files, rows = SRC.read_label_columns(spark, escaped if len(few) <= NAMED_FILES else source)
        by_file = lambda df: df.withColumn("file", SRC.logical_file("path"))
        counts = confusion_columns(by_file(rows), "truth", "pred", group=("file",)).select("file", *COUNTS)
        errors = by_file(files).groupBy("file").agg(F.min("error").alias("error"))
        out = changed.join(counts, "file", "left").join(errors, "file", "left").select(
            "file", "version", "bytes", *[F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS], "error")
        out = out.select("*", *_run_columns("file"), F.lit("counts").alias("kind"))
    else:
        out = spark.createDataFrame([], ARRIVALS)
    out.select(*ARRIVALS.fieldNames()).coalesce(1).write.mode("append").parquet(arrivals)
    return n


def expect(runs: DataFrame, arrivals: str) -> None:
    """Announce launched runs (script, model, input, run, launched: a timestamp)."""
    rows = runs.select(*RUN_KEY, F.lit("expected").alias("kind"), F.unix_millis("launched").alias("version"))
    for f in ARRIVALS:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows.select(*ARRIVALS.fieldNames()).coalesce(1).write.mode("append").parquet(arrivals)


class RunCounts(StatefulProcessor):
    """The files of one run by version, and until when it is waited for."""

    def __init__(self, limit_ms: int | None):
        self.limit_ms = limit_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file string", "version long, tp long, fp long, fn long, tn long, error string")
        self.launch = handle.getValueState("launch", "launched long, deadline long")

    def _newest(self) -> int | None:
        return max((v[0] for v in self.files.values()), default=None)

    def _row(self, key, error: str | None = None) -> pd.DataFrame:
        values = list(self.files.values())
        error = error or min((v[5] for v in values if v[5] is not None), default=None)
        counts = [None if error else int(sum(v[i] or 0 for v in values)) for i in range(1, 5)]
        row = [*key[:3], None if key[3] is None else int(key[3]), *counts, None if error else sum(counts), error]
        return pd.DataFrame([row], columns=RUNS.fieldNames()).astype({c: "Int64" for c in ("run", *COUNTS, "n_total")})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        changed = False
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.kind == "expected":
                    self._wait(int(r.version), timerValues.getCurrentProcessingTimeInMs())
                    continue
                file, version = (r.file,), int(r.version)
                if self.files.containsKey(file) and self.files.getValue(file)[0] > version:
                    continue
                error = r.error if isinstance(r.error, str) else None
                self.files.updateValue(file, (version, *(0 if error else int(getattr(r, c)) for c in COUNTS), error))
                changed = True
        if changed:
            if self.launch.exists() and (self._newest() or 0) > self.launch.get()[0]:
                self.handle.deleteTimer(self.launch.get()[1])
                self.launch.clear()
            yield self._row(key)

    def _wait(self, launched: int, now: int) -> None:
        if self.limit_ms is None or (self._newest() or 0) > launched:
            return
        if self.launch.exists():
            self.handle.deleteTimer(self.launch.get()[1])
        deadline = now + self.limit_ms
        self.launch.update((launched, deadline))
        self.handle.registerTimer(deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.launch.exists():
            self.launch.clear()
            yield self._row(key, K.ERROR_TIMEOUT)

    def close(self) -> None:
        pass


def start_run_metrics(spark: SparkSession, arrivals: str, table_dir: str, checkpoint_dir: str, available_now: bool = True,
                      max_files_per_trigger: int | None = None, limit_sec: float | None = None, every: str = "10 seconds"):
    """Start the stream over ``arrivals``; returns the StreamingQuery. ``limit_sec`` bounds the wait for expected runs."""
    reader = spark.readStream.schema(ARRIVALS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    limit = None if limit_sec is None else int(limit_sec * 1000)
    updates = reader.parquet(arrivals).groupBy(*RUN_KEY).transformWithStateInPandas(
        RunCounts(limit), RUNS, "Update", "None" if limit is None else "ProcessingTime")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        batch = materialize(batch, "run-updates")
        if batch.isEmpty():
            return
        key = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in RUN_KEY]
        latest = F.row_number().over(Window.partitionBy(*RUN_KEY).orderBy(F.col("error").isNull().desc()))
        batch = batch.withColumn("_nth", latest).filter("_nth = 1").drop("_nth")
        before = _version(spark, table_dir, epoch_id)
        kept = before.alias("t").join(batch.alias("b"), key, "left_anti")
        batch.unionByName(kept).write.mode("overwrite").parquet(f"{table_dir}/v={epoch_id}")
        _drop_versions(spark, table_dir, keep=2)

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    given = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps the settings that it was started with
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, given) if given else spark.conf.unset(PROVIDER)


def _versions(spark: SparkSession, table_dir: str) -> list[int]:
    """The numbers of the complete versions, from one listing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/v=*/_SUCCESS")
    done = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in done)


def _version(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame:
    """The last complete version (older than ``before``); an empty table if there is none."""
    found = [v for v in _versions(spark, table_dir) if before is None or v < before]
    return spark.read.schema(RUNS).parquet(f"{table_dir}/v={found[-1]}") if found else spark.createDataFrame([], RUNS)


def _drop_versions(spark: SparkSession, table_dir: str, keep: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for v in _versions(spark, table_dir)[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/v={v}"), True)


def run_metrics_table(spark: SparkSession, table_dir: str) -> DataFrame:
    """The runs of the last complete version, with precision / recall / F1 / accuracy derived on read; NULL beside an error."""
    return prf_accuracy(_version(spark, table_dir))


class RunMetrics:
    """The folders of one such stream, for callers that poll and process what is there step by step."""

    def __init__(self, spark: SparkSession, source: str, home: str | None = None):
        home = home or shared_path(spark, "run-metrics")
        self.spark, self.source = spark, source
        self.arrivals, self.table, self.checkpoint = f"{home}/arrivals", f"{home}/table", f"{home}/checkpoint"

    def step(self) -> DataFrame:
        """Poll once, process what has come, and return the table."""
        poll(self.spark, self.source, self.arrivals)
        start_run_metrics(self.spark, self.arrivals, self.table, self.checkpoint).awaitTermination()
        return run_metrics_table(self.spark, self.table)


def stream_once(spark: SparkSession, source_dir: str) -> DataFrame:
    """Run the stream over what is in ``source_dir`` and return the published metrics."""
    return RunMetrics(spark, source_dir).step()
