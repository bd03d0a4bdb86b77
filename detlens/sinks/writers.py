"""Sinks: quoted CSV (K1), predictions tables (K2), metrics as CSV and key=value text
(K3), JSON results (K4), the per-run archive (K5) and the text report (K6).

Spark writes a directory of part files per table; names the reference derives for a
file (model + input) become partition values, so one table holds every artifact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.lines import CSV_LINE_OPTIONS
from detlens.functions.text import artifact_key
from detlens.operators.metrics import metric_across_files
from detlens.operators.runs import RUN_KEYS, per_run_metrics, summary_entries
from detlens.session import materialize

QUOTE_ALL_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"',
                     "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
MINIMAL_OPTIONS = {"header": "true", **CSV_LINE_OPTIONS}


def write_quoted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: every field quoted, quotes doubled, '\\n' line ends."""
    df.write.mode(mode).options(**QUOTE_ALL_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by=(), **options) -> None:
    """Minimal quoting; whitespace kept as is.

    Partitioned writes are rebalanced on the partition columns first: AQE aims at about
    one file per partition value and splits values too large for one task, instead of
    every task writing a small file into every partition directory.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).options(**{**MINIMAL_OPTIONS, **options})
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_predictions(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: the six prediction columns, one table partition per (script, artifact, run)."""
    out = runs.select(
        "script", artifact_key("model", "input").alias("artifact"), "run", *K.PREDICTION_TABLE_COLUMNS
    )
    write_csv(out, path, mode, partition_by=("script", "artifact", "run"))


def metrics_kv_lines(metrics: DataFrame, model_col: str = "model", input_col: str = "input",
                     elapsed_col: str | None = None) -> DataFrame:
    """K3: (input, key, line) rows of ``key=value`` text in the report's order: counts as
    integers, ratios with 6 decimals, undefined as ``nan``, elapsed with 1 decimal."""
    def fmt6(c):
        return F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("nan"))

    items = [("model", F.col(model_col)), ("input", F.col(input_col))]
    if elapsed_col:
        items.append(("elapsed_sec", F.format_string("%.1f", F.col(elapsed_col))))
    for c in ("n_total", "n_gold_yes", "n_gold_no", "tp_yes", "fp_yes", "fn_yes", "tp_no", "fp_no", "fn_no"):
        items.append((c, F.col(c).cast("string")))
    for c in ("accuracy", "precision_yes", "recall_yes", "f1_yes", "precision_no", "recall_no", "f1_no", "macro_f1"):
        items.append((c, fmt6(c)))
    items.append(("mean_edit_distance_TP_no",
                  F.coalesce(F.col("mean_edit_distance_TP_no").cast("string"), F.lit("nan"))))
    kv = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), v.alias("value"))
                   for i, (k, v) in enumerate(items)])
    out = metrics.select(F.col(input_col).alias("input"), F.inline(kv))
    return out.select("input", F.col("i").cast("bigint").alias("i"), "key",
                      F.concat(F.col("key"), F.lit("="), F.col("value")).alias("line"))


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: the metrics row as CSV and as key=value text (one partition per input)."""
    write_csv(metrics, f"{path}/csv", mode)
    lines = metrics_kv_lines(metrics, elapsed_col="elapsed_sec" if "elapsed_sec" in metrics.columns else None)
    lines.orderBy("input", "i").select("input", "line").write.mode(mode).partitionBy("input").text(f"{path}/txt")


def write_json(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """K4: JSON lines; undefined values are written as null (not dropped, not NaN)."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


RUN_PARTITIONS = ("session", "script", "model", "input", "run")


def write_run_archive(runs: DataFrame, path: str, session: str, mode: str = "append", scoring_mode: str = "table",
                      job_id: str | None = None, started: str | None = None, ended: str | None = None) -> None:
    """K5: three tables partitioned by session / script / model / input / run: the runs' predictions,
    their metrics (confusion and ratios), and what is known of each run."""
    runs = stored_runs(runs)
    keyed = runs.withColumn("session", F.lit(session))
    write_csv(keyed.select(*RUN_PARTITIONS, *K.PREDICTION_TABLE_COLUMNS), f"{path}/predictions", mode, partition_by=RUN_PARTITIONS)
    per_run = per_run_metrics(runs).withColumn("session", F.lit(session))
    write_json(per_run.select(*RUN_PARTITIONS, *nested_result()), f"{path}/metrics", mode, partition_by=RUN_PARTITIONS)
    about = run_info(scoring_mode, job_id, started, ended)
    info = keyed.select(*RUN_PARTITIONS).distinct().select(*RUN_PARTITIONS, F.struct(*about).alias("run_info"))
    write_json(info, f"{path}/run_info", mode, partition_by=RUN_PARTITIONS)


def stored_runs(runs: DataFrame) -> DataFrame:
    """The runs' keys and predictions as a table, for sinks that read them several times: scored and parsed once."""
    return materialize(runs.select(*RUN_KEYS, "run", "doc_id", "pos", *K.PREDICTION_TABLE_COLUMNS), "runs")


def run_info(scoring_mode: str = "table", job_id: str | None = None, started: str | None = None, ended: str | None = None) -> list[Column]:
    """What is known of a run. The seed is the run's index."""
    given = {"mode": scoring_mode, "job_id": job_id, "start_time": started, "end_time": ended}
    return [F.col("script").alias("script"), F.col("model").alias("model"), F.col("input").alias("input"),
            *[F.lit(v).cast("string").alias(k) for k, v in given.items()],
            F.col("run").alias("run_index"), F.col("run").alias("seed"), artifact_key("model", "input").alias("predictions_file")]


def nested_result() -> list[Column]:
    """Counts and ratios as the two structs of a result document."""
    return [F.struct("tp", "fp", "fn", "tn", "n_total").alias("confusion"),
            F.struct("precision", "recall", "f1", "accuracy").alias("metrics")]


def write_results(per_file: DataFrame, path: str, metric: str = "f1", mode: str = "overwrite") -> None:
    """K4: the results document of a directory: ``files``, a JSON line for each in the order of their paths
    (with an error in place of numbers where there is one), and ``aggregate``, one line."""
    error = "error" if "error" in per_file.columns else F.lit(None).cast("string").alias("error")
    files = per_file.select(F.col("file").alias("path"), *nested_result(), error)
    bad = F.col("error").isNotNull()
    files = files.select("path", *[F.when(~bad, F.col(c)).alias(c) for c in ("confusion", "metrics")], "error")
    write_json(files.orderBy("path"), f"{path}/files", mode)
    good = files.filter(~bad).select("metrics.*")
    write_json(metric_across_files(good, metric), f"{path}/aggregate", mode)


def write_summary(across: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: the summary of all launch scripts, a JSON line each in their order."""
    write_json(summary_entries(across).orderBy("script"), path, mode)


def report_lines(annotated: DataFrame, tags: bool = False) -> DataFrame:
    """K6: (doc_id, value): a ``Sentence:`` and an ``Output:`` line followed by two blank lines, or a
    ``Sentence:`` and a ``Tags:`` line."""
    second, end = ("Tags:", "") if tags else ("Output:", "\n\n")
    body = F.concat(F.lit("Sentence:"), F.col("sentence"), F.lit("\n" + second), F.col("output"), F.lit(end))
    return annotated.select("doc_id", body.alias("value"))


def write_report(annotated: DataFrame, path: str, mode: str = "overwrite", tags: bool = False, compression: str = "none") -> None:
    """The report in the order of the documents."""
    report_lines(annotated, tags).orderBy("doc_id").select("value").write.mode(mode).text(path, compression=compression)
