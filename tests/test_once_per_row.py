"""Work is done once: per row, per file or per run, whatever reads it afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.labels import label_eval
from detlens.functions.replies import predict
from detlens.functions.text import clean_text
from detlens.operators import metrics as M
from detlens.sinks import writers as SNK
from detlens.sources import files as SRC


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_parsed_once(spark):
    rows = spark.createDataFrame([("no the cat", "cat")], "reply string, noun_phrase string")
    assert _plan(predict(rows)).count("substring_index(") == 1


def test_cleaned_text_is_collapsed_once(spark):
    df = spark.createDataFrame([("a   b\tc d ",), (" NaN ",), (" ",), (None,)], "t string").select(clean_text("t").alias("c"))
    assert [r["c"] for r in df.collect()] == ["a b c d", "", "", ""]
    assert _plan(df).count("regexp_replace(") == 1


def test_eval_labels_need_no_null_check(spark):
    df = spark.createDataFrame([(" A ",), (None,), ("TRUE",), ("x",)], "v string")
    out = df.select(label_eval("v").alias("a"), label_eval("v", True).alias("b"))
    assert [tuple(r) for r in out.collect()] == [("yes", "yes"), (None, None), ("yes", "TRUE"), ("x", "x")]
    assert "isnull" not in _plan(out).lower()


def test_counts_read_mapped_labels(spark):
    df = spark.createDataFrame([("f", "a", "b")], "file string, t string, p string")
    assert _plan(M.confusion_columns(df, "t", "p", group=("file",))).count("CASE WHEN") <= 2


def test_logical_file_without_a_regex(spark):
    paths = ["file:/x/a=1/part-0.csv", "file:/x/a.csv", "part-0", "file:/x\ny/part-1"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(SRC.logical_file("path").alias("f"))
    assert [r["f"] for r in df.collect()] == ["file:/x/a=1", "file:/x/a.csv", "", "file:/x\ny"]


def test_counts_by_path_equal_counts_by_file(spark, tmp_path):
    at = lambda name: str(tmp_path / f"100% a/artifact={name}")
    lines = [("s,np,yes,c,yes,np",), ("s,np,no,c,yes,np",), ("sentence,noun_phrase",), ("",)]
    for name in ("m__i__predictions.csv", "other.csv"):
        spark.createDataFrame(lines, "value string").repartition(2).write.text(at(name))
    rows = SRC.data_lines(spark, str(tmp_path)).withColumn("cls", F.when(F.col("value").contains(",no,"), "fp").otherwise("tp"))
    got = SRC.prediction_counts(M.confusion_from_classes(rows, group=("path",))).collect()
    assert [(r["tp"], r["fp"], r["n_total"]) for r in got] == [(1, 1, 2)]
    by_file = SRC.scan_prediction_dir(spark, str(tmp_path)).groupBy("file").count().collect()
    assert [(r["file"], r["count"]) for r in by_file] == [(got[0]["file"], 2)]


def test_label_rows_are_not_joined_for_want_of_long_files(spark, tmp_path):
    spark.createDataFrame([("yes", "no")], "grammatical string, grammatical_pred string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/a")
    files, rows = SRC.read_label_columns(spark, str(tmp_path))
    assert [r["error"] for r in files.collect()] == [None]
    assert "Join" not in _plan(rows) and rows.count() == 1


def test_an_archive_asks_for_its_runs_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            asked.add(len(pdf))
            yield pdf

    names = ["script", "model", "input", "run", "doc_id", "pos", *K.PREDICTION_TABLE_COLUMNS]
    schema = ", ".join(f"{n} {'bigint' if n in ('run', 'doc_id', 'pos') else 'string'}" for n in names)
    runs = spark.createDataFrame([("j", "m", "i", 1, 1, p, "s", "np", "yes", "np", "yes", "np") for p in range(3)], schema)
    SNK.write_run_archive(runs.mapInPandas(seen, schema), str(tmp_path), "s1", mode="overwrite")
    assert asked.value == 3
