"""Round trips through the sources and sinks, streaming = batch, the driver entry
points, and the DuckDB oracle on the small fixture."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from detlens.constants import PREDICTION_TABLE_COLUMNS
from detlens.functions.labels import format_benchmark
from detlens.functions.lines import classify_line, csv_line
from detlens.operators import metrics as M
from detlens.operators import runs as RU
from detlens.operators.scoring import batch_score
from detlens.plans import queries as Q
from detlens.plans import views as V
from detlens.session import local_path, shared_path
from detlens.sinks import writers as SNK
from detlens.sources import files as SRC
from detlens.streaming import run_metrics as ST

TABLES = ("documents", "labels", "conversations", "benchmark")


def test_quoted_csv_round_trip(spark):
    rows = [("a,b", 'say "hi"', "multi\nline", "é ü ß", " lead", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    path = shared_path(spark, "t-quoted")
    SNK.write_quoted_csv(df, path)
    text = "".join(open(os.path.join(local_path(path), f), encoding="utf-8").read()
                   for f in sorted(os.listdir(local_path(path))) if f.endswith(".csv"))
    assert text.startswith('"a","b","c","d","e","f"\n')
    back = SRC.read_csv(spark, path).first()
    # An empty field reads back as missing, as with pandas' CSV reader.
    assert tuple(back) == rows[0][:5] + (None,)


def test_csv_line_matches_writer(spark):
    df = spark.createDataFrame([("x, y", 'q"q', "", None, "plain", "a b")], "a string, b string, c string, "
                               "d string, e string, f string")
    line = df.select(csv_line("a", "b", "c", "d", "e", "f").alias("l")).first()["l"]
    assert line == '"x, y","q""q",,,plain,a b'


def test_encoding_detection(spark):
    root = shared_path(spark, "t-enc")
    df = spark.createDataFrame([("1", "café ß"), ("2", "naïve")], "id string, t string")
    for enc in ("utf-8", "cp1252"):
        SNK.write_csv(df.coalesce(1), f"{root}/{enc}", encoding=enc)
    latin = f"{root}/latin1/x.csv"
    os.makedirs(os.path.dirname(local_path(latin)), exist_ok=True)
    with open(local_path(latin), "wb") as fh:
        fh.write("id,t\n3,".encode() + b"\x81\xe9\n")
    enc = {os.path.basename(os.path.dirname(r["path"])): r["encoding"]
           for r in SRC.detect_encodings(spark, root).collect()}
    assert enc == {"utf-8": "utf-8", "cp1252": "cp1252", "latin1": "latin1"}
    got = {r["id"]: r["t"] for r in SRC.read_csv_any_encoding(spark, root).collect()}
    assert got["1"] == "café ß" and got["2"] == "naïve" and got["3"] == "\x81é"


def test_tokenize_lines_keeps_empty_tokens(spark):
    df = spark.createDataFrame([("a  b ",), ("",)], "value string")
    got = [(r["pos"], r["w"]) for r in SRC.tokenize_lines(df).collect()]
    assert got == [(0, "a"), (1, ""), (2, "b"), (0, "")]


def test_find_label_columns(spark):
    headers = ["grammatical_gt,prediction", "x,grammatical_pred", "grammatical", 'grammatical,"mine"', "", None, "grammatical_pred, grammatical"]
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in SRC.find_label_columns(F.col("h"), pred="mine").items()]).collect()]
    assert got[0] == ("grammatical_gt", "prediction", None) and got[1][2] == "Could not detect ground-truth column"
    assert got[2][2] == "Could not detect prediction column" and got[3] == ("grammatical", "mine", None)
    assert got[4][2] == got[5][2] == "No columns to parse from file" and got[6] == ("grammatical", "grammatical_pred", None)


def test_charset_is_decided_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,t\n1,\u00c1\n".encode() + b"2,\xe9\n")  # byte 81 on a line of valid UTF-8
    (tmp_path / "b.csv").write_bytes(b"t,id\n\x93x\x94,3\n")
    (tmp_path / "c.csv").write_bytes(b"id,t\n4,N/A\n5,\"a\nb\"\n")
    (tmp_path / "d.csv").write_bytes(b"")
    chosen = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in SRC.detect_encodings(spark, str(tmp_path)).collect()}
    assert chosen == {"a.csv": "latin1", "b.csv": "cp1252", "c.csv": "utf-8", "d.csv": "utf-8"}
    rows = {r["id"]: r["t"] for r in SRC.read_csv_any_encoding(spark, str(tmp_path)).collect()}
    assert rows == {"1": "\u00c3\u0081", "2": "\u00e9", "3": "\u201cx\u201d", "4": None, "5": "a\nb"}


def test_no_csv_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    assert SRC.read_csv_any_encoding(spark, str(tmp_path)).count() == 0


def test_files_without_rows_are_reported(spark, tmp_path):
    (tmp_path / "1__predictions.csv").write_text("grammatical,grammatical_pred\nyes,yes\n")
    (tmp_path / "2__predictions.csv").write_text("grammatical,grammatical_pred\n")
    (tmp_path / "3__predictions.csv").write_text("")
    files, rows = SRC.read_label_columns(spark, str(tmp_path))
    assert [r["error"] for r in files.orderBy("path").collect()] == [None, None, "No columns to parse from file"]
    assert [tuple(r)[1:] for r in rows.collect()] == [("yes", "yes")]
    lines = SRC.scan_prediction_dir(spark, str(tmp_path)).withColumn("cls", classify_line("value"))
    got = SRC.every_file(SRC.prediction_files(spark, str(tmp_path)), M.confusion_from_classes(lines, group=("file",))).collect()
    assert [r["file"].rsplit("/", 1)[1][0] for r in got] == ["1", "2", "3"] and all(r["n_total"] == 0 for r in got[1:])


def test_missing_value_strings(spark, tmp_path):
    (tmp_path / "b.csv").write_text("sentence,noun_phrase,gold_fix\ns,n,N/A\ns,n,#NA\ns,n,the n\n")
    rows = format_benchmark(SRC.read_csv(spark, str(tmp_path / "b.csv"))).collect()
    assert [(r["grammatical"], r["corrected"]) for r in rows] == [("yes", "n"), ("yes", "n"), ("no", "the n")]


def _factory(n):
    class Scorer:
        def score(self, batch, seed=0):
            return batch["doc_id"].map(lambda _: str(n))

    return Scorer


def test_each_call_scores_with_its_own_model(spark):
    df = spark.range(8).withColumnRenamed("id", "doc_id").repartition(4)
    for n in range(30):
        assert {r["reply"] for r in batch_score(df, _factory(n)).collect()} == {str(n)}


def test_one_build_per_worker_and_call(spark, tmp_path):
    folder, scorer = str(tmp_path), _factory(1)

    def factory():
        import os
        import uuid
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return scorer()

    batch_score(spark.range(400).withColumnRenamed("id", "doc_id").repartition(40), factory).collect()
    built = [name.split("-")[0] for name in os.listdir(folder)]
    assert built and len(built) == len(set(built))


def test_session_settings_of_the_caller_stay(spark):
    from detlens.session import configure

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50m")
    try:
        configure(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "50m"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        configure(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from detlens.session import ensure_checkpoint_dir

    class Context(SimpleNamespace):
        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    fake = SimpleNamespace(sparkContext=Context(master="spark://host:7077"), conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_stream_equals_batch(spark, sf_dir):
    runs = V.runs(V.english_words(spark, sf_dir))
    source = shared_path(spark, "t-stream")
    SNK.write_csv(runs.select("sentence", "noun_phrase", "grammatical", "corrected", "grammatical_pred",
                              "correction", *ST.RUN_KEY), source, partition_by=ST.RUN_KEY,
                  emptyValue='""')
    streamed = ST.stream_once(spark, source).select("script", "run", "tp", "fp", "fn", "tn")
    batch = M.confusion_columns(runs, "grammatical", "grammatical_pred", group=("script", "run")).select(
        "script", "run", "tp", "fp", "fn", "tn")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["input", "n_total", "n_gold_yes"]
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert all(name in entry_mod.oracle_sql() for name in Q.REGISTRY)


CHECKED = os.environ.get("DETLENS_ORACLE_QUERIES",
                         "benchmark_metrics,metric_across_runs,missing_determiner,extra_determiner,annotate,"
                         "manifest_join,detect_columns,metrics_kv").split(",")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in CHECKED if n])
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = entry_mod.queries()[name](spark, sf_dir)
    res = duck.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _bag(df.collect(), df.columns) == _bag(res.fetchall(), ocols)


def test_scoring_run_writes_predictions_and_metrics(spark, sf_dir):
    from detlens.operators.scoring import TemplateScorer
    from detlens.plans.scoring_run import run_scoring

    bench = V.benchmark_table(V.english_words(spark, sf_dir))
    out = shared_path(spark, "t-scoring-run")
    m = run_scoring(bench, TemplateScorer, out, model="templates", input_name="bench.csv", keep=("doc_id", "pos"))
    row = m.first()
    direct = M.benchmark_metrics(V.preds(V.english_words(spark, sf_dir))).first()
    assert row["model"] == "templates" and row["input"] == "bench.csv" and row["elapsed_sec"] >= 0
    for c in ("n_total", "tp_yes", "fp_yes", "fn_yes", "tp_no", "fp_no", "fn_no"):
        assert row[c] == direct[c], c
    assert abs(row["macro_f1"] - direct["macro_f1"]) < 1e-12
    lines = spark.read.text(f"{out}/metrics/txt").collect()
    keys = [r["value"].split("=", 1)[0] for r in lines]
    assert keys[:3] == ["model", "input", "elapsed_sec"] and keys[-1] == "mean_edit_distance_TP_no"


def test_launch_script_with_two_python_commands(spark, tmp_path):
    (tmp_path / "a.sh").write_text("python setup.py install\npython3 x/score.py \\\n --model 'm' --input=d/i.csv\n")
    (tmp_path / "b.sh").write_text("python other.py --model no --input no\npython score.py --model m2 --input i2\n")
    (tmp_path / "c.txt").write_text("python score.py --model no --input no\n")
    scripts = RU.read_launch_scripts(spark, f"{tmp_path}/*.sh")
    got = {r["script"]: (r["model"], r["input"]) for r in RU.parse_launch_scripts(scripts).collect()}
    assert got == {"a.sh": ("m", "i.csv"), "b.sh": ("no", "no")}
    got = {r["script"]: (r["model"], r["input"]) for r in RU.parse_launch_scripts(scripts, "score.py").collect()}
    assert got == {"a.sh": ("m", "i.csv"), "b.sh": ("m2", "i2")}


def test_reports_are_ordered_and_whole(spark, tmp_path):
    df = spark.createDataFrame([(2, " b", " b"), (1, " a", " a [EXTRA DET:a] ")], "doc_id long, sentence string, output string")
    SNK.write_report(df, f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == [
        "Sentence: a", "Output: a [EXTRA DET:a] ", "", "", "Sentence: b", "Output: b", "", ""]
    SNK.write_report(df, f"{tmp_path}/tags", tags=True)
    assert [r["value"][:5] for r in spark.read.text(f"{tmp_path}/tags").collect()] == ["Sente", "Tags:"] * 2


def test_tags_are_bound_by_position(spark):
    """Whatever the model spelled; a table that breaks off leaves the other words without a tag."""
    from detlens.operators.detect import with_tags

    ctx = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "c", None)], "doc_id long, pos long, w string, n string")
    tags = spark.createDataFrame([(1, 0, "a", "noun"), (1, 1, "x", "noun")], "doc_id long, pos long, word string, tag string")
    got = [(r["tag_w"], r["tag_n"]) for r in with_tags(ctx, tags).orderBy("pos").collect()]
    assert got == [("noun", "noun"), ("noun", None), (None, None)]


def test_long_document_is_one_report_entry(spark):
    """Longer than any bound on words that the annotation ever had."""
    from detlens.operators import detect as D

    words = spark.createDataFrame([(1, "s", ["the", "cat"] * 5000)], "doc_id long, source string, words array<string>")
    model = D.BigramModel(V.tokens_ctx(words))
    rows = D.annotate(words, D.extra_flags(model, D.determiner_flags(model), with_missing=True)).collect()
    assert len(rows) == 1 and rows[0]["sentence"].count(" ") == 10000


def test_predictions_file_has_six_columns(spark, sf_dir):
    from detlens.plans.scoring_run import run_scoring
    from detlens.operators.scoring import TemplateScorer

    out = shared_path(spark, "t-six")
    run_scoring(V.benchmark_table(V.english_words(spark, sf_dir)).limit(50), TemplateScorer, out, "m", "i.csv", keep=("doc_id", "pos"))
    assert tuple(spark.read.option("header", "true").csv(f"{out}/predictions").columns) == PREDICTION_TABLE_COLUMNS
    assert "doc_id" in spark.read.parquet(f"{out}/scored").columns


def test_archive_holds_metrics_and_run_info(spark, sf_dir, tmp_path):
    runs = V.runs(V.english_words(spark, sf_dir)).filter("run = 3")
    SNK.write_run_archive(runs, str(tmp_path), "s1", mode="overwrite", started="2024-01-01T00:00:00")
    info = spark.read.json(f"{tmp_path}/run_info").select("run_info.*").first().asDict()
    assert set(info) == {"script", "model", "input", "mode", "job_id", "run_index", "seed", "start_time", "end_time", "predictions_file"}
    assert info["seed"] == info["run_index"] == 3 and info["job_id"] is None
    first = spark.read.json(f"{tmp_path}/metrics").first()
    assert first["confusion"]["n_total"] == sum(first["confusion"][c] for c in ("tp", "fp", "fn", "tn"))
