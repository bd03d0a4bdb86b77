"""One scoring run end to end, as Spark jobs.

prepare (P1, P6) -> score through the seam (L0) -> parse replies (P7-P11) -> write the
predictions table (K2) -> metrics (A1, A4-A6) with the elapsed seconds (A9) -> write
metrics as CSV and key=value text (K3).

The replies are kept in a ledger of committed batches (``operators.ledger``): a run that was killed, called again
with ``resume``, asks the model about no committed row again. Within a batch, a retried task's rows are asked
about again. The six-column predictions file and the metrics are made from the ledger.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.labels import label_wide_pass, require_columns
from detlens.functions.prompts import judge_prompt
from detlens.functions.replies import predict
from detlens.operators import ledger
from detlens.operators.metrics import benchmark_metrics
from detlens.sinks.writers import write_csv, write_metrics


def run_scoring(bench: DataFrame, factory: Callable[[], object], out_dir: str, model: str, input_name: str,
                seed: int = 0, keep=(), resume: bool = False, batches: int = ledger.BATCHES) -> DataFrame:
    """Score a benchmark table (sentence, noun_phrase, grammatical, corrected) and write
    ``out_dir/predictions`` and ``out_dir/metrics``; returns the metrics row. Rows are named by the ``keep`` columns,
    or by sentence and phrase. ``elapsed_sec`` is this call's time for scoring."""
    require_columns(bench, K.BENCHMARK_COLUMNS)
    spark = bench.sparkSession
    prompts = bench.withColumn("prompt", judge_prompt("sentence", "noun_phrase"))
    if not resume:
        ledger.drop(spark, f"{out_dir}/replies")
    started = time.perf_counter()
    scored = ledger.score_once(prompts, factory, f"{out_dir}/replies", keep or ("sentence", "noun_phrase"), seed=seed, batches=batches)
    elapsed = time.perf_counter() - started
    preds = predict(scored).select(
        *keep, "sentence", "noun_phrase", label_wide_pass("grammatical").alias("grammatical"), "corrected",
        "grammatical_pred", "correction", "fix_pred",
    )
    preds.write.mode("overwrite").parquet(f"{out_dir}/scored")
    written = spark.read.parquet(f"{out_dir}/scored")
    write_csv(written.select(*K.PREDICTION_TABLE_COLUMNS), f"{out_dir}/predictions", emptyValue='""')
    metrics = benchmark_metrics(written).select(
        F.lit(model).alias("model"), F.lit(input_name).alias("input"),
        F.lit(round(elapsed, 3)).alias("elapsed_sec"), "*",
    )
    write_metrics(metrics, f"{out_dir}/metrics")
    return spark.read.options(header="true", inferSchema="true").csv(f"{out_dir}/metrics/csv")
