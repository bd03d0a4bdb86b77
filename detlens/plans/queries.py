"""Registered queries: one per operator of the inventory, each over the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the DuckDB oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions import labels as L
from detlens.functions import lines as LN
from detlens.functions import prompts as PR
from detlens.functions import replies as R
from detlens.functions import text as TX
from detlens.operators import detect as D
from detlens.operators import lm as LM
from detlens.operators import metrics as M
from detlens.operators import model_detect as MD
from detlens.operators import runs as RU
from detlens.operators.scoring import ChunkingScorer, DigestModel, TaggingScorer, TemplateScorer, batch_score
from detlens.operators.tagging import iob_tag, pos_tag
from detlens.plans import views as V
from detlens.session import materialize, shared_path
from detlens.sinks import named_files as NF
from detlens.sinks import writers as SNK
from detlens.sources import files as SRC
from detlens.sources.csv_splits import plain_path
from detlens.streaming import run_metrics as ST


def _words(spark, sf_dir):
    return V.english_words(spark, sf_dir)


# ---------------------------------------------------------------------------
# Flagship and metrics
# ---------------------------------------------------------------------------
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents -> np_items -> P6 -> replies -> P7-P11 -> A1+A4+A5+A6 per input."""
    p = V.preds(_words(spark, sf_dir)).withColumnRenamed("source", "input")
    return M.benchmark_metrics(p, group=("input",))


def confusion_per_class(spark, sf_dir):
    p = V.preds(_words(spark, sf_dir)).withColumnRenamed("source", "input")
    return M.confusion_per_class(p, group=("input",))


def confusion_columns(spark, sf_dir):
    """A2 on the real labels: gold = quality, prediction = n_chars > 500, per source."""
    return M.confusion_columns(V.lab(spark, sf_dir), "grammatical", "grammatical_pred", group=("source",))


def prf_accuracy(spark, sf_dir):
    """A2 + A4 over the scored predictions, per input."""
    p = V.preds(_words(spark, sf_dir)).withColumnRenamed("source", "input")
    return M.prf_accuracy(M.confusion_columns(p, "grammatical", "grammatical_pred", group=("input",)))


def macro_f1(spark, sf_dir):
    """A5 over the real labels (per-class F1 from A1, then the macro mean), per source."""
    lab = V.lab(spark, sf_dir).withColumn("grammatical_pred", L.label_wide("grammatical_pred"))
    m = M.benchmark_metrics(lab.withColumn("corrected", F.lit("")).withColumn("fix_pred", F.lit("")),
                            group=("source",))
    return m.select("source", "f1_yes", "f1_no", "macro_f1")


def confusion_regex(spark, sf_dir):
    """A3: predictions rendered as CSV lines, classified by P17, counted per (script, run)."""
    lines = RU.prediction_lines(V.runs(_words(spark, sf_dir)))
    cls = lines.withColumn("cls", LN.classify_line("line"))
    return M.confusion_from_classes(cls, group=("script", "run"))


def _rounded(df: DataFrame, columns) -> DataFrame:
    """Six digits: two engines add doubles up in different orders."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def per_run_metrics(spark, sf_dir):
    return RU.per_run_metrics(V.runs(_words(spark, sf_dir)))


def metric_across_files(spark, sf_dir):
    """Per script directory, aggregate of the per-run F1."""
    out = M.metric_across_files(per_run_metrics(spark, sf_dir), "f1", group=("script",))
    return _rounded(out, ["mean", "std"])


def metric_across_runs(spark, sf_dir):
    """Per script, mean/std of every metric and sum/mean of every count over runs."""
    out = RU.across_runs(per_run_metrics(spark, sf_dir))
    return _rounded(out, [f"{m}_{x}" for m in K.METRIC_NAMES for x in ("mean", "std")])


def run_table_with_summary(spark, sf_dir):
    """Per-run metric rows followed by the mean and std rows."""
    out = RU.run_table(per_run_metrics(spark, sf_dir))
    summary = F.col("run").isin("mean", "std")
    return out.withColumns({m: F.when(summary, F.round(m, 6)).otherwise(F.col(m)) for m in K.METRIC_NAMES})


# ---------------------------------------------------------------------------
# Scalar operators over derived rows
# ---------------------------------------------------------------------------
def clean_text(spark, sf_dir):
    docs = V.spread(V.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", TX.clean_text("text").alias("clean"))


def _raw_words(spark, sf_dir):
    docs = V.spread(V.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(V.WORD_PATTERN), 0)).alias("pos", "raw")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def label_strict(spark, sf_dir):
    return _raw_words(spark, sf_dir).select("doc_id", "pos", L.label_strict("raw").alias("label"))


def label_wide(spark, sf_dir):
    return _raw_words(spark, sf_dir).select("doc_id", "pos", L.label_wide("raw").alias("label"))


def label_wide_pass(spark, sf_dir):
    return _raw_words(spark, sf_dir).select("doc_id", "pos", L.label_wide_pass("raw").alias("label"))


def label_eval(spark, sf_dir):
    return _raw_words(spark, sf_dir).select(
        "doc_id", "pos", L.label_eval("raw").alias("label"), L.label_eval("raw", True).alias("label_cs")
    )


def format_benchmark(spark, sf_dir):
    b = V.benchmark_table(_words(spark, sf_dir))
    return b.select("doc_id", "pos", "sentence", "noun_phrase", "grammatical", "corrected")


def _replies(spark, sf_dir):
    return V.replies(_words(spark, sf_dir))


def parse_reply(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("_p", R.parse_reply(R.reply_text("reply")))
    return r.select("doc_id", "pos", F.col("_p.verdict").alias("verdict"), F.col("_p.fix").alias("fix"))


def reply_verdict(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("_f", R.fallback_verdict(R.reply_text("reply")))
    return r.select(
        "doc_id", "pos", F.col("_f.found").alias("found"),
        F.when(F.col("_f.found"), F.col("_f.verdict")).alias("verdict"),
        F.when(F.col("_f.found"), F.col("_f.fix")).alias("fix"),
    )


def clean_fix(spark, sf_dir):
    r = _replies(spark, sf_dir)
    return r.select("doc_id", "pos", TX.clean_fix("reply").alias("fix"))


def is_placeholder(spark, sf_dir):
    r = _replies(spark, sf_dir)
    return r.select("doc_id", "pos", TX.is_placeholder("reply").alias("placeholder"))


def final_verdict(spark, sf_dir):
    p = V.preds(_words(spark, sf_dir))
    return p.select("doc_id", "pos", *K.PREDICTION_TABLE_COLUMNS)


def artifact_key(spark, sf_dir):
    r = V.runs(_words(spark, sf_dir)).select("script", "model", "input").distinct()
    return r.select("script", "model", "input", TX.artifact_key("model", "input").alias("artifact"))


def edit_distance(spark, sf_dir):
    p = V.preds(_words(spark, sf_dir))
    return p.select("doc_id", "pos", TX.edit_distance("corrected", "correction").alias("distance"))


def build_prompt(spark, sf_dir):
    b = V.benchmark_table(_words(spark, sf_dir))
    return b.select("doc_id", "pos", PR.judge_prompt("sentence", "noun_phrase").alias("prompt"))


def classify_line(spark, sf_dir):
    lines = RU.prediction_lines(V.runs(_words(spark, sf_dir)))
    return lines.select(
        "doc_id", "pos", LN.classify_line("line").alias("cls"), LN.classify_line("line", True).alias("cls_cs")
    )


def batch_score_query(spark, sf_dir):
    """L0 through the mapInPandas seam with the default template scorer."""
    b = V.benchmark_table(_words(spark, sf_dir))
    scored = batch_score(b.select("doc_id", "pos", "noun_phrase", "alt"), TemplateScorer)
    return scored.select("doc_id", "pos", "reply")


# ---------------------------------------------------------------------------
# Language-model, tagging and detector operators
# ---------------------------------------------------------------------------
def _all_words(spark, sf_dir):
    return V.document_words(spark, sf_dir)


def neighbour_words(spark, sf_dir):
    return V.tokens_ctx(_all_words(spark, sf_dir)).select("doc_id", "pos", "w", "p", "n")


def next_word_model(spark, sf_dir):
    """L1: every observed bigram with its count, c(w) and add-one log-probability."""
    grouped = LM.grouped_counts(V.tokens_ctx(_all_words(spark, sf_dir)))
    vocab = LM.vocabulary_size(grouped)
    return LM.with_totals(LM.transitions(grouped)).select(
        "w", "n", "c", "cw", LM.log_prob("c", "cw", vocab).alias("lp")
    )


def topk_next_word(spark, sf_dir):
    ctx = V.tokens_ctx(_all_words(spark, sf_dir))
    return LM.top_next_words(LM.bigram_counts(LM.transitions(ctx)), K.TOP_NEXT_WORDS)


def perplexity(spark, sf_dir):
    """L2: only counts, totals and vocabulary, none of the detector's features."""
    ctx = V.tokens_ctx(_all_words(spark, sf_dir))
    grouped = LM.grouped_counts(ctx)
    pairs = LM.with_totals(LM.transitions(grouped)).select(
        "w", "n", LM.log_prob("c", "cw", LM.vocabulary_size(grouped)).alias("lp"))
    total = LM.transitions(grouped).agg(F.sum("c")).first()[0] or 0
    return LM.doc_perplexity(LM.doc_log_probs(LM.transitions(ctx), materialize(pairs, "log-probs"), total))


def pos_tags(spark, sf_dir):
    return V.tokens_ctx(_words(spark, sf_dir)).select("doc_id", "pos", "w", pos_tag("w").alias("tag"))


def iob_tags(spark, sf_dir):
    ctx = V.tokens_ctx(_words(spark, sf_dir))
    return ctx.select("doc_id", "pos", "w", iob_tag(pos_tag("w"), pos_tag("p")).alias("iob"))


def missing_determiner(spark, sf_dir):
    words = _words(spark, sf_dir)
    model = D.BigramModel(V.tokens_ctx(words), words=words)
    return D.missing_determiners(D.determiner_flags(model))


def extra_determiner(spark, sf_dir):
    words = _words(spark, sf_dir)
    model = D.BigramModel(V.tokens_ctx(words), words=words)
    return D.extra_determiners(D.extra_flags(model, D.determiner_flags(model)))


def annotate(spark, sf_dir):
    words = _words(spark, sf_dir)
    model = D.BigramModel(V.tokens_ctx(words), words=words)
    decided = D.extra_flags(model, D.determiner_flags(model), with_missing=True)
    return D.annotate(words, decided)


def detect_with_tags(spark, sf_dir):
    """The detector with tags from a model's replies: POS prompt, scoring seam, reply parse, and
    a join of the parsed tags to the tokens by position. The replies spell words in their own way."""
    words = V.english_words(spark, sf_dir)
    prompts = words.select("doc_id", PR.pos_prompt(F.array_join("words", " ")).alias("prompt"))
    replies = batch_score(prompts, TaggingScorer)
    tags = replies.select("doc_id", F.posexplode(R.parse_pos_reply("reply")).alias("pos", "t")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "t.tag")
    model = D.BigramModel(V.tokens_ctx(words))
    model.trans = LM.transitions(D.with_tags(model.ctx, materialize(tags, "tags")))
    return D.missing_determiners(D.determiner_flags(model))


def detect_with_model(spark, sf_dir):
    """L5 + L6 with a language model's probabilities and perplexities in place of the corpus counts: the English
    documents' sentences, the stand-in model, one call for each distinct text. det is NULL for an extra determiner."""
    docs = V.spread(V.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text"))
    flags = materialize(MD.model_flags(materialize(MD.sentences(docs), "sentences"), DigestModel), "flags")
    extra = D.extra_determiners(flags).withColumn("det", F.lit(None).cast("string"))
    return D.missing_determiners(flags).unionByName(extra)


def _tag_replies(words, kind: str):
    """Replies in 'word/tag' form built per document from the rule tagger (varied
    formatting: newlines, a leading underscore, upper-case tags, a preface)."""

    def piece(x, i):
        if kind == "pos":
            tag = pos_tag(x)
            shown = F.when(i % 7 == 0, F.concat(F.lit("_"), F.upper(tag))).otherwise(tag)
        else:
            shown = iob_tag(pos_tag(x), pos_tag(F.when(i > 0, F.get("words", i - 1))))
        sep = F.when(i % 5 == 0, F.lit("\n")).otherwise(F.lit(" "))
        return F.concat(sep, x, F.lit("/"), shown)

    body = F.array_join(F.transform("words", piece), "")
    if kind == "iob":
        body = F.concat(F.lit(K.IOB_PREFACE), body)
    return words.filter(F.size("words") > 0).select("doc_id", body.alias("reply"))


def _parsed(replies, parse, tag: str):
    out = replies.select("doc_id", F.posexplode(parse("reply")).alias("pos", "wt"))
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("wt.word").alias("w"), F.col("wt.tag").alias(tag))


def parse_pos_reply(spark, sf_dir):
    return _parsed(_tag_replies(_words(spark, sf_dir), "pos"), R.parse_pos_reply, "tag")


def parse_iob_reply(spark, sf_dir):
    return _parsed(_tag_replies(_words(spark, sf_dir), "iob"), R.parse_iob_reply, "iob")


# ---------------------------------------------------------------------------
# Sources, sinks, manifest and streaming (S1-S8, J1, K1-K6, ST1). Each writes data
# Spark derives from the driver tables into the shared folder and reads it back.
# ---------------------------------------------------------------------------
def _relative_file(col: str = "file"):
    """The part of a table-partition path below the table root."""
    return F.regexp_extract(F.col(col), r"(script=.*)\z", 1)


def scan_csv_quoted(spark, sf_dir):
    """Conversations (multi-line text, quotes) through a CSV write and a read by splits."""
    conv = V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text"
    )
    path = shared_path(spark, "conversations-csv")
    SNK.write_csv(conv, path, emptyValue='""')
    return SRC.read_csv(spark, path, columns=["conv_id", "turn", "role", "text"])


def scan_csv_encoding(spark, sf_dir):
    """Documents written in three charsets and two column orders, read back with a decision per
    file. A text that is a missing-value string reads as NULL. The folders' names hold a blank and a percent sign."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.lit("N/A")).when(
        F.col("doc_id") % 50 == 8, F.concat(F.lit("\u0081"), F.col("text"))).otherwise(F.col("text")))
    root = shared_path(spark, "documents-charsets")
    for k, enc in enumerate(("utf-8", "cp1252", "latin1")):
        part = docs.filter(F.col("doc_id") % 3 == k)
        part = part.withColumn("text", F.replace("text", F.lit("\u0081"), F.lit(""))) if enc == "cp1252" else part
        SNK.write_csv(part.select("text", "doc_id") if enc == "cp1252" else part, f"{root}/100% {enc}", encoding=enc, emptyValue='""')
    return SRC.read_csv_any_encoding(spark, root, columns=["doc_id", "text"])


def tokenize_lines(spark, sf_dir):
    """Documents as sentence-per-line text files, read back and split on spaces."""
    lines = V.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    path = shared_path(spark, "sentence-lines")
    lines.write.mode("overwrite").text(path)
    toks = SRC.tokenize_lines(spark.read.text(path))
    return toks.select(F.md5("value").alias("line_id"), "pos", "w")


def _with_odd_files(spark, root, script, broken=False):
    """Beside the predictions, a file of the header alone and one of a blank line; ``broken`` adds files that can't be
    read: one that ends within quotes, one with a record of too many fields, one that isn't UTF-8."""
    header = ",".join(K.PREDICTION_TABLE_COLUMNS)
    row = "s,np,yes,np,yes,np"
    files = {"header": [header], "empty": [""]}
    if broken:
        files |= {"quote": [header, row, row[:-2] + '"np', row], "long": [header, row, row + ",np"]}
    at = lambda name: f"{root}/script={script}/artifact={name}{K.PREDICTIONS_SUFFIX}/run=0"
    for name, lines in files.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at(name))
    if broken:
        accents = spark.createDataFrame([("é", "np", "yes", "np", "yes", "np")], list(K.PREDICTION_TABLE_COLUMNS))
        SNK.write_csv(accents.coalesce(1), at("bytes"), encoding="cp1252")


def dir_scan_confusion(spark, sf_dir):
    """S6 + S5 + P17 + A3 + A4: predictions tables written per (script, artifact, run),
    scanned recursively by glob, raw lines classified, metrics per file. A file without data
    lines counts zero. The folder's name holds a blank and a percent sign."""
    root = f"{shared_path(spark, 'predictions')}/all runs 100%"
    SNK.write_predictions(V.runs(_words(spark, sf_dir)), root)
    _with_odd_files(spark, root, "odd")
    lines = SRC.data_lines(spark, root).withColumn("cls", LN.classify_line("value"))
    found = SRC.prediction_counts(M.confusion_from_classes(lines, group=("path",)))
    counts = SRC.every_file(SRC.prediction_files(spark, root), found)
    return M.prf_accuracy(counts).select(_relative_file().alias("file"), "tp", "fp", "fn", "tn", "n_total",
                                         "precision", "recall", "f1", "accuracy")


def detect_columns(spark, sf_dir):
    """S7 + A2 + U2: files with three header variants, one of a header alone, one of a blank line and three that can't be
    read; counts where the columns are found, an error row where they are not. The folder's name holds a blank and a
    percent sign."""
    runs = materialize(V.runs(_words(spark, sf_dir)).select(
        "script", "run", "sentence", "noun_phrase", "grammatical", "grammatical_pred"), "runs")
    root = f"{shared_path(spark, 'mixed-headers')}/all runs 100%"
    variant = F.col("run") % 3
    base = ("script", "run", "sentence", "noun_phrase")
    SNK.write_csv(runs.filter(variant == 0).select(*base, "grammatical", "grammatical_pred"), root,
                  partition_by=("script", "run"))
    SNK.write_csv(runs.filter(variant == 1).select(*base, F.col("grammatical").alias("grammatical_gt"),
                                                    F.col("grammatical_pred").alias("prediction")),
                  root, mode="append", partition_by=("script", "run"))
    SNK.write_csv(runs.filter(variant == 2).select(*base, "grammatical"), root, mode="append",
                  partition_by=("script", "run"))
    _with_odd_files(spark, root, "odd", broken=True)
    files, rows = SRC.read_label_columns(spark, root)
    files = files.select(SRC.logical_file("path").alias("file"), "error").distinct()
    counts = M.confusion_columns(rows.withColumn("file", SRC.logical_file("path")), "truth", "pred", group=("file",))
    names = ("tp", "fp", "fn", "tn", "n_total")
    out = files.join(counts, "file", "left").orderBy("file")
    zero = [F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in names]
    return out.select(_relative_file().alias("file"), *zero, "error")


def sink_roundtrip(spark, sf_dir):
    """K1: the benchmark table written fully quoted and read back unchanged."""
    b = V.benchmark_table(_words(spark, sf_dir)).select("doc_id", "pos", *K.BENCHMARK_COLUMNS)
    path = shared_path(spark, "benchmark-csv")
    SNK.write_quoted_csv(b, path)
    back = SRC.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"),
                       *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in K.BENCHMARK_COLUMNS])


def metrics_kv(spark, sf_dir):
    """K3: the metrics row as ``key=value`` lines per input (elapsed time excluded)."""
    m = benchmark_metrics(spark, sf_dir).withColumn("model", F.lit(TemplateScorer.name))
    return SNK.metrics_kv_lines(m)


def metrics_json(spark, sf_dir):
    """K4: per-run results as nested JSON (confusion + metrics), read back and flattened."""
    per_run = per_run_metrics(spark, sf_dir)
    nested = per_run.select(
        "script", "run",
        F.struct("tp", "fp", "fn", "tn", "n_total").alias("confusion"),
        F.struct("precision", "recall", "f1", "accuracy").alias("metrics"),
    )
    path = shared_path(spark, "run-results-json")
    SNK.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("script", "run", "confusion.*", "metrics.*")


def results_json(spark, sf_dir):
    """K4: the results document of all runs' files, files and aggregate, written and read back."""
    per_run = per_run_metrics(spark, sf_dir).withColumn("file", F.concat_ws("/", "script", "run"))
    path = shared_path(spark, "results-json")
    SNK.write_results(per_run, path)
    files = spark.read.json(f"{path}/files").select("path", F.col("confusion.n_total").alias("n"), F.col("metrics.f1").alias("value"))
    total = spark.read.json(f"{path}/aggregate").select(
        F.concat(F.lit("aggregate "), F.col("metric")).alias("path"), F.col("used").alias("n"), F.round("mean", 6).alias("value"))
    return files.unionByName(total)


def summary_json(spark, sf_dir):
    """A10: the summary of all launch scripts as JSON lines, read back and flattened."""
    path = shared_path(spark, "summary-json")
    SNK.write_summary(RU.across_runs(per_run_metrics(spark, sf_dir)), path)
    back = spark.read.json(path)
    parts = [F.round(f"metrics_{x}.{m}", 6).alias(f"{m}_{x}") for m in K.METRIC_NAMES for x in ("mean", "std")]
    parts += [F.col(f"confusion_{x}.{c}").cast(t).alias(f"{c}_{x}") for c in K.CONFUSION_NAMES for x, t in (("sum", "bigint"), ("mean", "double"))]
    return back.select("script", "model", "input", "runs", *parts)


def run_archive(spark, sf_dir):
    """K5: predictions, metrics and run info, partitioned by session/script/model/input/run, read
    back through partition discovery: every run's rows, F1, seed and artefact name."""
    path = shared_path(spark, "run-archive")
    SNK.write_run_archive(V.runs(_words(spark, sf_dir)), path, session="s0", mode="overwrite")
    key = ["script", "model", "input", "run"]
    rows = spark.read.options(**SRC.CSV_READ_OPTIONS).csv(f"{path}/predictions").groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    scores = spark.read.json(f"{path}/metrics").select(*key, "metrics.f1")
    info = spark.read.json(f"{path}/run_info").select(*key, "run_info.seed", "run_info.predictions_file")
    return rows.join(scores, key).join(info, key).withColumn("run", F.col("run").cast("bigint"))


def run_files(spark, sf_dir):
    """K2 + K5: every run's predictions, metrics and run info as files under their derived names, read back by name: the
    rows, counts and F1 of each predictions file and what lies beside it."""
    root = shared_path(spark, "run-files")
    NF.write_run_files(V.runs(_words(spark, sf_dir)), root, "s0", order=("doc_id", "pos"))
    files, rows = SRC.read_label_columns(spark, root, glob=f"*{K.PREDICTIONS_SUFFIX}")
    home = lambda c: F.regexp_extract(c, r"(s0/.*)/[^/]*\z", 1).alias("folder")
    counts = M.confusion_columns(rows.withColumn("folder", home("path")), "truth", "pred", group=("folder",))
    read = lambda name: (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
                         .text(root, wholetext=True).select("value", home(plain_path("_metadata.file_path"))))
    f1 = F.get_json_object("value", "$.metrics.f1").cast("double").alias("f1")
    info = read("run_info.json").select("folder", F.get_json_object("value", "$.seed").cast("bigint").alias("seed"))
    named = files.filter("error IS NULL").select(home("path"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"))
    return named.join(counts, "folder").join(read("metrics.json").select("folder", f1), "folder").join(info, "folder").select(
        "folder", "name", "tp", "fp", "fn", "tn", "f1", "seed")


def report_text(spark, sf_dir):
    """K6: the detector report written as text and read back line by line."""
    words = _words(spark, sf_dir)
    model = D.BigramModel(V.tokens_ctx(words), words=words)
    decided = D.extra_flags(model, D.determiner_flags(model), with_missing=True)
    path = shared_path(spark, "detector-report")
    # The report is several times as large as the documents.
    SNK.write_report(D.annotate(words, decided), path, compression="gzip")
    return spark.read.text(path).select(F.col("value").alias("line"))


def report_tags(spark, sf_dir):
    """K6 + P14 + P16: IOB prompts through the scoring seam, replies cleaned, the tag report written
    and read back line by line."""
    words = _words(spark, sf_dir).filter(F.size("words") > 0).select("doc_id", F.array_join("words", " ").alias("sentence"))
    replies = batch_score(words.withColumn("prompt", PR.iob_prompt("sentence")), ChunkingScorer)
    path = shared_path(spark, "tag-report")
    SNK.write_report(replies.select("doc_id", "sentence", R.clean_iob_reply("reply").alias("output")), path, tags=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _launch_scripts(spark, sf_dir):
    """A launch script for every source, written as files and read back by glob."""
    sources = V.table(spark, sf_dir, "documents").select("source").distinct()
    path = shared_path(spark, "launch-scripts")
    RU.launch_scripts(sources).repartition("script").write.partitionBy("script").text(path)
    return RU.read_launch_scripts(spark, f"{path}/script=*.sh")


def launch_manifest(spark, sf_dir):
    """Launch scripts (one per source) parsed into (script, model, input, error)."""
    return RU.parse_launch_scripts(_launch_scripts(spark, sf_dir))


def manifest_join(spark, sf_dir):
    """Parsed launch scripts joined to the predictions found for their artifact key."""
    manifest = RU.parse_launch_scripts(_launch_scripts(spark, sf_dir))
    return RU.manifest_join(manifest, V.runs(_words(spark, sf_dir)))


def stream_run_metrics(spark, sf_dir):
    """ST1: prediction files as they arrive, and again when they are replaced; per-run counts as state. At first every
    second run's files hold the runs' gold labels as predictions, then all of them hold their own."""
    runs = V.runs(_words(spark, sf_dir))
    stream = ST.RunMetrics(spark, shared_path(spark, "arriving-predictions"))
    own = materialize(runs.select(*K.PREDICTION_TABLE_COLUMNS, *ST.RUN_KEY), "runs")
    first = own.withColumn("grammatical_pred", F.when(F.col("run") % 2 == 0, F.col("grammatical")).otherwise(F.col("grammatical_pred")))
    for version in (first, own):
        SNK.write_csv(version, stream.source, partition_by=ST.RUN_KEY, emptyValue='""')
        out = stream.step()
    return out.select("script", "run", "tp", "fp", "fn", "tn", "n_total", "precision", "recall", "f1", "accuracy")


REGISTRY = {
    "benchmark_metrics": benchmark_metrics,
    "confusion_per_class": confusion_per_class,
    "confusion_columns": confusion_columns,
    "prf_accuracy": prf_accuracy,
    "macro_f1": macro_f1,
    "confusion_regex": confusion_regex,
    "metric_across_files": metric_across_files,
    "metric_across_runs": metric_across_runs,
    "run_table_with_summary": run_table_with_summary,
    "clean_text": clean_text,
    "label_strict": label_strict,
    "label_wide": label_wide,
    "label_wide_pass": label_wide_pass,
    "label_eval": label_eval,
    "format_benchmark": format_benchmark,
    "parse_reply": parse_reply,
    "reply_verdict": reply_verdict,
    "clean_fix": clean_fix,
    "is_placeholder": is_placeholder,
    "final_verdict": final_verdict,
    "artifact_key": artifact_key,
    "edit_distance": edit_distance,
    "build_prompt": build_prompt,
    "classify_line": classify_line,
    "batch_score": batch_score_query,
    "neighbour_words": neighbour_words,
    "next_word_model": next_word_model,
    "topk_next_word": topk_next_word,
    "perplexity": perplexity,
    "pos_tags": pos_tags,
    "iob_tags": iob_tags,
    "missing_determiner": missing_determiner,
    "extra_determiner": extra_determiner,
    "annotate": annotate,
    "detect_with_tags": detect_with_tags,
    "detect_with_model": detect_with_model,
    "parse_pos_reply": parse_pos_reply,
    "parse_iob_reply": parse_iob_reply,
    "scan_csv_quoted": scan_csv_quoted,
    "scan_csv_encoding": scan_csv_encoding,
    "tokenize_lines": tokenize_lines,
    "dir_scan_confusion": dir_scan_confusion,
    "detect_columns": detect_columns,
    "sink_roundtrip": sink_roundtrip,
    "metrics_kv": metrics_kv,
    "metrics_json": metrics_json,
    "results_json": results_json,
    "summary_json": summary_json,
    "run_archive": run_archive,
    "run_files": run_files,
    "report_text": report_text,
    "report_tags": report_tags,
    "launch_manifest": launch_manifest,
    "manifest_join": manifest_join,
    "stream_run_metrics": stream_run_metrics,
}
