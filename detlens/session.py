"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "detlens") -> SparkSession:
    """Return the active session, or build a local one configured for this library.

    On a cluster the session is normally created by the launcher; this only fills in
    settings the library relies on (AQE, skew joins, the legacy charset switch for
    cp1252) and leaves cluster-provided values alone.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # Local mode runs every task inside the driver JVM, so its heap is the executor memory.
        builder = builder.config("spark.driver.memory", os.environ.get("DETLENS_DRIVER_MEMORY", _local_heap()))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def _local_heap() -> str:
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(24, int(total * 0.6 / 2**30)))}g"


ADAPTIVE_BROADCAST_BYTES = str(32 * 1024 * 1024)

#: Rows are sent to Python in batches of at most this (a larger row is a batch of its own), so that a worker's memory
#: does not grow with the length of the texts. A worker holds a batch about ten times over.
ARROW_BATCH_BYTES = str(4 * 1024 * 1024)

#: Settings the operators depend on, used where the caller has set none. Broadcasts are decided
#: by AQE from the measured size of a finished shuffle stage (below 32 MB), not from plan-time
#: estimates: the size of an exploded token table is estimated from its compressed source and
#: can be off by orders of magnitude. Larger sides stay sort-merge joins, which AQE can split.
DEFAULTS = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": ADAPTIVE_BROADCAST_BYTES,
    "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BATCH_BYTES,
}


def configure(spark: SparkSession) -> None:
    """Set what the operators depend on, but nothing that the caller has set (safe to call repeatedly)."""
    given = dict(spark.conf.getAll)
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses ``spark.checkpoint.dir``. Where it is unset, a local master (tests, notebooks) gets a
    fresh folder; a cluster gets an error, as its executors would not share a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="detlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/detlens/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for code that must touch the folder from Python)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def materialize(df, name: str, partition_by: str | None = None):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    Cuts the lineage with one job (a reliable RDD checkpoint computes its input twice
    unless cached); the files survive executor loss and give AQE real sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)


def drop_intermediate(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables under the shared checkpoint folder.

    Call it once the DataFrames that read them have been consumed. Uses the Hadoop
    FileSystem of the folder, so it works for any scheme the cluster uses.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/detlens"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))
