"""Repeated runs: per-run metrics, cross-run aggregate (A8), summary rows (U1),
launch-script manifest (S8) and its join to the predictions (J1).

All runs are rows of one table keyed by (script, model, input, run); the two levels
of aggregation are two ``groupBy``s, both partial + final.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.lines import classify_line, csv_line
from detlens.functions.text import artifact_key, basename, col, pattern
from detlens.operators.metrics import confusion_from_classes, prf_accuracy

RUN_KEYS = ("script", "model", "input")


def prediction_lines(runs: DataFrame) -> DataFrame:
    """Each prediction row as the CSV line its predictions file holds."""
    return runs.select(
        *RUN_KEYS, "run", "doc_id", "pos", csv_line(*K.PREDICTION_TABLE_COLUMNS).alias("line")
    )


def per_run_metrics(runs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Raw-line mode (A3 + A4), the mode used for repeated runs."""
    lines = prediction_lines(runs).withColumn("cls", classify_line("line", case_sensitive))
    return prf_accuracy(confusion_from_classes(lines, group=(*RUN_KEYS, "run")))


def across_runs(per_run: DataFrame) -> DataFrame:
    """Per (script, model, input): runs, mean/std of each metric (undefined values
    dropped; one value -> std 0), and the sum and mean of each confusion count."""
    aggs = [F.count(F.lit(1)).alias("runs")]
    for m in K.METRIC_NAMES:
        aggs.append(F.avg(m).alias(f"{m}_mean"))
        aggs.append(F.stddev_pop(m).alias(f"{m}_std"))
    for c in K.CONFUSION_NAMES:
        aggs.append(F.sum(c).alias(f"{c}_sum"))
    out = per_run.groupBy(*RUN_KEYS).agg(*aggs)
    for c in K.CONFUSION_NAMES:
        out = out.withColumn(f"{c}_mean", F.col(f"{c}_sum") / F.col("runs"))
    return out


def run_table(per_run: DataFrame) -> DataFrame:
    """Per script, one row per run then a ``mean`` and a ``std`` row (run is a string)."""
    metrics = list(K.METRIC_NAMES)
    rows = per_run.select("script", F.col("run").cast("string").alias("run"), *metrics)
    row = lambda name, f: F.struct(F.lit(name).alias("run"), *[f(m).alias(m) for m in metrics])
    both = per_run.groupBy("script").agg(F.array(row("mean", F.avg), row("std", F.stddev_pop)).alias("both"))
    return rows.unionByName(both.select("script", F.inline("both")))


def summary_entries(across: DataFrame) -> DataFrame:
    """A10: one nested entry per script (the shape of the JSON summary)."""
    return across.select(
        *RUN_KEYS, "runs",
        F.struct(*[F.col(f"{m}_mean").alias(m) for m in K.METRIC_NAMES]).alias("metrics_mean"),
        F.struct(*[F.col(f"{m}_std").alias(m) for m in K.METRIC_NAMES]).alias("metrics_std"),
        F.struct(*[F.col(f"{c}_sum").alias(c) for c in K.CONFUSION_NAMES]).alias("confusion_sum"),
        F.struct(*[F.col(f"{c}_mean").alias(c) for c in K.CONFUSION_NAMES]).alias("confusion_mean"),
    )


# ---------------------------------------------------------------------------
# S8 launch-script manifest, J1 join to the predictions
# ---------------------------------------------------------------------------
ANY_PROGRAM = r"[^\s\\]*\.py"


def _arg(cmd: Column, name: str) -> Column:
    pat = pattern(K.PAT_ARGUMENT, name=name)
    return F.when(cmd.rlike(pat), F.regexp_extract(cmd, pat, 1))


def read_launch_scripts(spark: SparkSession, paths: str) -> DataFrame:
    """(script, text) of the launch scripts that the glob ``paths`` names, read whole. A table
    partition ``script=name`` stands for the file of that name."""
    files = spark.read.text(paths, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*\z", "")
    return files.select(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\Ascript=", "").alias("script"),
                        F.col("value").alias("text"))


def parse_launch_scripts(scripts: DataFrame, program: str | None = None) -> DataFrame:
    """(script, text) -> (script, model, input, error).

    Backslash-continued lines are joined, the python command running ``program`` (a file name) is
    isolated, by default the first one that has a ``--model`` (else the whole text is searched),
    then --model / --input are read in either ``--x v`` or ``--x=v`` form, bare or quoted; input
    keeps its base name.
    """
    merged = F.regexp_replace(col("text"), K.PAT_CONTINUATION, " ")
    name = ANY_PROGRAM if program is None else r"(?:[^\s\\]*/)?" + re.escape(program)
    commands = F.regexp_extract_all(merged, F.lit(pattern(K.PAT_COMMAND, program=name)), 0)
    if program is None:
        commands = F.filter(commands, lambda c: c.contains("--model"))
    staged = scripts.select("script", F.coalesce(F.get(commands, 0), merged).alias("_cmd"))
    staged = staged.select("script", _arg(F.col("_cmd"), "model").alias("_m"), _arg(F.col("_cmd"), "input").alias("_i"))

    def unquote(name):
        v = F.col(name)
        quoted = (F.length(v) >= 2) & (
            (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
        )
        return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    staged = staged.select("script", unquote("_m").alias("model"), unquote("_i").alias("_input"))
    error = (
        F.when(F.col("model").isNull() | (F.col("model") == ""), F.concat(F.lit("--model not found in "), F.col("script")))
        .when(F.col("_input").isNull() | (F.col("_input") == ""), F.concat(F.lit("--input not found in "), F.col("script")))
    )
    return staged.select(
        "script",
        F.when(error.isNull(), F.col("model")).alias("model"),
        F.when(error.isNull(), basename("_input")).alias("input"),
        error.alias("error"),
    )


def launch_scripts(sources: DataFrame) -> DataFrame:
    """(script, text): one launch script per source, with varied quoting and line breaks."""
    s = F.col("source")
    variant = F.ascii(F.substring(s, -1, 1)) % 3
    model = F.concat(F.lit("org/model-"), s)
    model_arg = (
        F.when(variant == 0, model)
        .when(variant == 1, F.concat(F.lit('"'), model, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), model, F.lit("'")))
    )
    sep = F.when(variant == 1, F.lit("=")).otherwise(F.lit(" "))
    text = F.concat(
        F.lit("#!/bin/bash\n#SBATCH --job-name="), s,
        F.lit("\n#SBATCH --time=24:00:00\nmodule load python\ncd $HOME/project\npython setup.py install --input=none\npython3 score.py \\\n    --model "),
        model_arg,
        F.lit(" \\\n    --input"), sep, F.lit("data/"), s, F.lit(".csv \\\n    --seed $SEED\necho done\n"),
    )
    return sources.select(F.concat(F.lit("job_"), s, F.lit(".sh")).alias("script"), text.alias("text"))


def manifest_join(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Each launch script's artifact key joined to the prediction rows found for it;
    scripts with no predictions keep a row with an error instead of waiting."""
    found = runs.groupBy(artifact_key("model", "input").alias("artifact")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run").alias("n_runs")
    )
    keyed = manifest.filter(F.col("error").isNull()).withColumn("artifact", artifact_key("model", "input"))
    joined = keyed.join(found, "artifact", "left")
    return joined.select(
        "script", "model", "input", "artifact",
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("n_runs", F.lit(0)).cast("bigint").alias("n_runs"),
        F.when(F.col("n_rows").isNull(), F.concat(F.lit("no predictions for "), F.col("artifact"))).alias("error"),
    )
