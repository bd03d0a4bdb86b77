"""Metrics (FIXTURES §5), invariants, segmented windows against brute force, the
tagger, the detector identities and the scoring seam."""

import math
import random

import pytest
from pyspark.sql import functions as F

from detlens.operators import metrics as M
from detlens.operators import runs as RU
from detlens.operators.scoring import TemplateScorer, batch_score
from detlens.operators.tagging import iob_tag, pos_tag
from detlens.operators.windows import suffix_sums
from detlens.plans import views as V


def counts_df(spark, rows):
    return spark.createDataFrame(rows, "k string, tp bigint, fp bigint, fn bigint, tn bigint").withColumn(
        "n_total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    )


def test_prf_accuracy_cases(spark):
    df = counts_df(spark, [("a", 2, 1, 1, 4), ("b", 0, 0, 3, 1), ("c", 0, 0, 0, 0)])
    got = {r["k"]: r for r in M.prf_accuracy(df).collect()}
    a = got["a"]
    assert (round(a["precision"], 6), round(a["recall"], 6), round(a["f1"], 6), a["accuracy"]) == (
        0.666667, 0.666667, 0.666667, 0.75)
    b = got["b"]
    assert b["precision"] is None and b["recall"] == 0.0 and b["f1"] is None and b["accuracy"] == 0.25
    c = got["c"]
    assert c["precision"] is None and c["recall"] is None and c["f1"] is None and c["accuracy"] is None


def test_macro_f1(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (0.5, 1.0)], "a double, b double")
    got = [r["m"] for r in df.select(M.macro_f1("a", "b").alias("m")).collect()]
    assert got == [0.5, None, 0.75]


def test_metric_across_files(spark):
    df = spark.createDataFrame([("d", 0.5, 0.1), ("d", 1.0, 0.2), ("d", None, 0.3), ("e", 0.5, 0.4)],
                               "g string, f1 double, accuracy double")
    got = {r["g"]: r for r in M.metric_across_files(df, "f1", group=("g",)).collect()}
    assert (got["d"]["count"], got["d"]["used"], got["d"]["mean"], got["d"]["std"]) == (3, 2, 0.75, 0.25)
    assert (got["e"]["mean"], got["e"]["std"]) == (0.5, 0.0)
    with pytest.raises(ValueError):
        M.metric_across_files(df, "precision")


def test_unknown_gold_counts_as_false_positive(spark):
    df = spark.createDataFrame(
        [("", "no", "c", "x"), ("no", "no", "the cat", "cat"), ("yes", "yes", "c", ""), ("maybe", "yes", "c", "")],
        "grammatical string, grammatical_pred string, corrected string, fix_pred string",
    )
    r = M.benchmark_metrics(df).first()
    assert (r["n_total"], r["tp_no"], r["fp_no"], r["fp_yes"], r["tp_yes"]) == (4, 1, 1, 1, 1)
    assert r["accuracy"] == 2 / 4
    assert r["mean_edit_distance_TP_no"] == 4.0
    cols = M.confusion_columns(df, "grammatical", "grammatical_pred").first()
    assert cols["n_total"] == 2  # rows whose labels are not yes/no are skipped


def test_confusion_invariants_on_driver_tables(spark, sf_dir):
    words = V.english_words(spark, sf_dir)
    p = V.preds(words)
    labelled = p.filter(F.col("grammatical").isin("yes", "no") & F.col("grammatical_pred").isin("yes", "no")).count()
    c = M.prf_accuracy(M.confusion_columns(p, "grammatical", "grammatical_pred")).first()
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == labelled
    if c["f1"] is not None:
        assert min(c["precision"], c["recall"]) - 1e-12 <= c["f1"] <= max(c["precision"], c["recall"]) + 1e-12


def test_raw_line_mode_equals_column_mode(spark, sf_dir):
    """No commas in any text field here, so the raw-line classes equal the column counts."""
    runs = V.runs(V.english_words(spark, sf_dir))
    by_lines = RU.per_run_metrics(runs).select("script", "run", "tp", "fp", "fn", "tn")
    by_cols = M.confusion_columns(runs, "grammatical", "grammatical_pred", group=("script", "run")).select(
        "script", "run", "tp", "fp", "fn", "tn")
    assert sorted(map(tuple, by_lines.collect())) == sorted(map(tuple, by_cols.collect()))


def test_run_table_and_summary(spark):
    rows = [("s", "m", "i", r, 1.0 * r, 0.5, 0.5, 0.5, 1, 1, 1, 1, 4) for r in (1, 2, 3)]
    per_run = spark.createDataFrame(
        rows, "script string, model string, input string, run bigint, accuracy double, f1 double, "
              "precision double, recall double, tp bigint, fp bigint, fn bigint, tn bigint, n_total bigint")
    table = {r["run"]: r for r in RU.run_table(per_run).collect()}
    assert set(table) == {"1", "2", "3", "mean", "std"}
    assert table["mean"]["accuracy"] == 2.0 and math.isclose(table["std"]["accuracy"], math.sqrt(2 / 3))
    a = RU.across_runs(per_run).first()
    assert (a["runs"], a["tp_sum"], a["tp_mean"], a["f1_std"]) == (3, 3, 1.0, 0.0)


def test_suffix_sums_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for key in range(5):
        for pos in range(rnd.randint(1, 40)):
            rows.append((key, pos, rnd.randint(-5, 9)))
    df = spark.createDataFrame(rows, "k bigint, pos bigint, v bigint")
    got = {(r["k"], r["pos"]): r["sfx_v"] for r in suffix_sums(df, "k", "pos", ["v"]).collect()}
    for k, pos, _ in rows:
        assert got[(k, pos)] == sum(v for kk, pp, v in rows if kk == k and pp >= pos)


@pytest.mark.parametrize(
    "word, tag",
    [("the", "article"), ("those", "determiner"), ("into", "preposition"), ("quickly", "adverb"),
     ("running", "verb"), ("famous", "adjective"), ("table", "adjective"), ("cat", "noun"), ("her", "determiner")],
)
def test_pos_tag_rules(spark, word, tag):
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(pos_tag("w").alias("t")).first()["t"] == tag


def test_iob_never_inside_after_outside(spark, sf_dir):
    ctx = V.tokens_ctx(V.english_words(spark, sf_dir))
    tagged = ctx.select("doc_id", "pos", iob_tag(pos_tag("w"), pos_tag("p")).alias("iob"))
    prev = ctx.select("doc_id", (F.col("pos") + 1).alias("pos"), iob_tag(pos_tag("w"), pos_tag("p")).alias("prev"))
    bad = tagged.join(prev, ["doc_id", "pos"]).filter((F.col("iob") == "I-NP") & (F.col("prev") == "O")).count()
    assert bad == 0


def test_template_scorer_equals_native_expression(spark, sf_dir):
    b = V.benchmark_table(V.english_words(spark, sf_dir)).select("doc_id", "pos", "noun_phrase", "alt")
    native = b.withColumn("reply", V.template_reply())
    seam = batch_score(b, TemplateScorer)
    assert native.exceptAll(seam).count() == 0 and seam.exceptAll(native).count() == 0


LAUNCH_CASES = [
    ("a.sh", "#!/bin/bash\npython3 /x/score.py --model org/m-1 --input data/in.csv\n", ("org/m-1", "in.csv", None)),
    ("b.sh", 'python score.py \\\n   --model="org/m 2" \\\n   --input=\'dir/sub/two.csv\'\n', ("org/m 2", "two.csv", None)),
    ("c.sh", "echo start\n/usr/bin/python3.11 run.py --input x.csv   --model  'q'\n", ("q", "x.csv", None)),
    ("d.sh", "python3 score.py --input only.csv\n", (None, None, "--model not found in d.sh")),
    ("e.sh", "python3 score.py --model m\n", (None, None, "--input not found in e.sh")),
    ("f.sh", "srun --model outer --input o.csv\npython3 score.py --model inner --input i.csv\n", ("inner", "i.csv", None)),
]


def test_launch_script_parsing(spark):
    df = spark.createDataFrame([(s, t) for s, t, _ in LAUNCH_CASES], "script string, text string")
    got = {r["script"]: (r["model"], r["input"], r["error"]) for r in RU.parse_launch_scripts(df).collect()}
    for script, _, expected in LAUNCH_CASES:
        assert got[script] == expected, script
    # With a program pattern that matches no command line, the whole text is searched.
    only = RU.parse_launch_scripts(df.filter(F.col("script") == "f.sh"), program=r"nothing\.py").first()
    assert (only["model"], only["input"]) == ("outer", "o.csv")


def test_manifest_join_reports_missing_predictions(spark):
    manifest = spark.createDataFrame([("s1", "m/x", "in.csv", None), ("s2", "m/y", "gone.csv", None)],
                                     "script string, model string, input string, error string")
    runs = spark.createDataFrame([("m/x", "in.csv", 1), ("m/x", "in.csv", 2)], "model string, input string, run bigint")
    got = {r["script"]: r for r in RU.manifest_join(manifest, runs).collect()}
    assert (got["s1"]["n_rows"], got["s1"]["n_runs"], got["s1"]["error"]) == (2, 2, None)
    assert got["s1"]["artifact"] == "m_x__in.csv__predictions.csv"
    assert got["s2"]["n_rows"] == 0 and got["s2"]["error"].startswith("no predictions for")
