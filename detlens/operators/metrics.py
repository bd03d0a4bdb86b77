"""Confusion counts and quality metrics.

Every count is a ``count_if`` inside one aggregate, so a table is scanned once and
the aggregation is partial (map-side) + final; undefined ratios are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlens.functions.labels import label_eval, label_wide
from detlens.functions.text import col, edit_distance


def ratio(num, den) -> Column:
    """num / den as double; NULL when den is 0 or either side is NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def f1(precision, recall) -> Column:
    p, r = col(precision), col(recall)
    return F.try_divide(F.lit(2.0) * p * r, p + r)


def macro_f1(f1_yes, f1_no) -> Column:
    """A5: mean of both; if one is undefined take the other."""
    a, b = col(f1_yes), col(f1_no)
    return F.coalesce((a + b) / F.lit(2.0), a, b)


# ---------------------------------------------------------------------------
# A1 + A4 + A5 + A6: the scorer's metrics row, per group
# ---------------------------------------------------------------------------
BENCHMARK_METRIC_COLUMNS = (
    "n_total", "n_gold_yes", "n_gold_no", "tp_yes", "fp_yes", "fn_yes", "tp_no", "fp_no", "fn_no",
    "accuracy", "precision_yes", "recall_yes", "f1_yes", "precision_no", "recall_no", "f1_no",
    "macro_f1", "mean_edit_distance_TP_no",
)


def confusion_per_class(df: DataFrame, group=(), truth="grammatical", pred="grammatical_pred") -> DataFrame:
    """A1 (+ A6 counts): per-class confusion; gold outside yes/no counts as a false positive."""
    t = label_wide(truth)
    p = col(pred)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(t == "yes").alias("n_gold_yes"),
        F.count_if(t == "no").alias("n_gold_no"),
        F.count_if((t == "yes") & (p == "yes")).alias("tp_yes"),
        F.count_if((t != "yes") & (p == "yes")).alias("fp_yes"),
        F.count_if((t == "yes") & (p != "yes")).alias("fn_yes"),
        F.count_if((t == "no") & (p == "no")).alias("tp_no"),
        F.count_if((t != "no") & (p == "no")).alias("fp_no"),
        F.count_if((t == "no") & (p != "no")).alias("fn_no"),
        F.count_if((t != "") & (p != "") & (t == p)).alias("n_correct"),
    )


def benchmark_metrics(df: DataFrame, group=(), truth="grammatical", pred="grammatical_pred",
                      corrected="corrected", fix="fix_pred") -> DataFrame:
    """A1+A4+A5+A6 in one pass: the metrics row of a scoring run, per group.

    Accuracy here divides by *all* rows (unknown gold included).
    """
    t = label_wide(truth)
    p = col(pred)
    both_no = (t == "no") & (p == "no")
    agg = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(t == "yes").alias("n_gold_yes"),
        F.count_if(t == "no").alias("n_gold_no"),
        F.count_if((t == "yes") & (p == "yes")).alias("tp_yes"),
        F.count_if((t != "yes") & (p == "yes")).alias("fp_yes"),
        F.count_if((t == "yes") & (p != "yes")).alias("fn_yes"),
        F.count_if(both_no).alias("tp_no"),
        F.count_if((t != "no") & (p == "no")).alias("fp_no"),
        F.count_if((t == "no") & (p != "no")).alias("fn_no"),
        F.count_if((t != "") & (p != "") & (t == p)).alias("_correct"),
        F.avg(F.when(both_no, edit_distance(corrected, fix))).alias("mean_edit_distance_TP_no"),
    )
    out = agg.select(
        *group,
        *BENCHMARK_METRIC_COLUMNS[:9],
        ratio("_correct", "n_total").alias("accuracy"),
        ratio("tp_yes", F.col("tp_yes") + F.col("fp_yes")).alias("precision_yes"),
        ratio("tp_yes", F.col("tp_yes") + F.col("fn_yes")).alias("recall_yes"),
        ratio("tp_no", F.col("tp_no") + F.col("fp_no")).alias("precision_no"),
        ratio("tp_no", F.col("tp_no") + F.col("fn_no")).alias("recall_no"),
        "mean_edit_distance_TP_no",
    )
    out = out.withColumn("f1_yes", f1("precision_yes", "recall_yes")).withColumn(
        "f1_no", f1("precision_no", "recall_no")
    )
    out = out.withColumn("macro_f1", macro_f1("f1_yes", "f1_no"))
    return out.select(*group, *BENCHMARK_METRIC_COLUMNS)


# ---------------------------------------------------------------------------
# A2 / A3 / A4: binary confusion (positive = yes) and its metrics
# ---------------------------------------------------------------------------
def confusion_columns(df: DataFrame, truth: str, pred: str, group=(), case_sensitive: bool = False) -> DataFrame:
    """A2: counts over rows whose both labels map to yes/no (FL1); others are skipped."""
    # Mapped once a row, before the counts read them.
    labelled = df.select(*group, label_eval(truth, case_sensitive).alias("_gold"), label_eval(pred, case_sensitive).alias("_pred"))
    g, p = F.col("_gold"), F.col("_pred")
    return labelled.groupBy(*group).agg(
        F.count_if((g == "yes") & (p == "yes")).alias("tp"),
        F.count_if((g == "no") & (p == "yes")).alias("fp"),
        F.count_if((g == "yes") & (p == "no")).alias("fn"),
        F.count_if((g == "no") & (p == "no")).alias("tn"),
    ).withColumn("n_total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def confusion_from_classes(df: DataFrame, cls: str = "cls", group=()) -> DataFrame:
    """A3: counts from classified raw lines."""
    c = col(cls)
    return df.groupBy(*group).agg(
        F.count_if(c == "tp").alias("tp"),
        F.count_if(c == "fp").alias("fp"),
        F.count_if(c == "fn").alias("fn"),
        F.count_if(c == "tn").alias("tn"),
    ).withColumn("n_total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def prf_accuracy(counts: DataFrame) -> DataFrame:
    """A4: precision, recall, F1, accuracy (labelled rows) from tp/fp/fn/tn."""
    out = counts.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio("tp", F.col("tp") + F.col("fn"))
    )
    out = out.withColumn("f1", f1("precision", "recall"))
    return out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), "n_total"))


def metric_across_files(per_file: DataFrame, metric: str = "f1", group=()) -> DataFrame:
    """Count, used (defined values), mean and population std of one metric."""
    if metric not in ("f1", "accuracy"):
        raise ValueError("metric must be 'f1' or 'accuracy'")
    m = F.col(metric)
    return per_file.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"),
        F.count(m).alias("used"),
        F.lit(metric).alias("metric"),
        F.avg(m).alias("mean"),
        F.stddev_pop(m).alias("std"),
    )
