"""DuckDB oracles for the source / sink / manifest / streaming queries.

The Spark queries write derived data to files and read it back; a faithful round
trip means these equal the same rows computed directly from the driver tables.
"""

from __future__ import annotations

from detlens import constants as K
from detlens.plans.oracle import (
    DETECT_VIEWS, PRED_VIEWS, RUN_VIEWS, V_BENCH, V_DOCS_EN, V_NP_ITEMS, V_RUNS,
    V_TOK, BENCH_METRICS_SELECT, _confusion_cols_sql, annotate_ctes, f1, iob_tag, label_eval, lit, pos_tag, ratio,
    sql_metric_across_runs, with_views,
)

# The artefact's name, as in ``functions.text.artifact_key``.
ARTIFACT = (
    r"regexp_replace(model, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || "
    r"regexp_extract(input, '([^/]*)/*$', 1) || " + lit(K.PREDICTIONS_SUFFIX)
)
M_ARTIFACT = (
    r"regexp_replace(m.model, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || "
    r"regexp_extract(m.input, '([^/]*)/*$', 1) || " + lit(K.PREDICTIONS_SUFFIX)
)


def sql_scan_csv_quoted():
    return ("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text "
            "FROM conversations")


def sql_scan_csv_encoding():
    # A third of the files is cp1252, which cannot hold the byte 81; N/A reads as missing.
    return ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 50 = 7 OR text = '' THEN NULL "
            "WHEN doc_id % 50 = 8 AND doc_id % 3 <> 1 THEN chr(129) || text ELSE text END AS text FROM documents")


def sql_tokenize_lines():
    return r"""
SELECT md5(line) AS line_id, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos, unnest(ws) AS w
FROM (SELECT line, string_split(regexp_replace(line, '\s+$', ''), ' ') AS ws
      FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))"""


def sql_dir_scan_confusion():
    return with_views(*RUN_VIEWS) + f"""
SELECT 'script=' || script || '/artifact=' || {ARTIFACT} || '/run=' || CAST(run AS VARCHAR) AS file,
       tp, fp, fn, tn, n_total, precision, recall, f1, accuracy FROM per_run
UNION ALL SELECT 'script=odd/artifact=' || name || '{K.PREDICTIONS_SUFFIX}/run=0', 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL
FROM (SELECT unnest(['header', 'empty']) AS name)"""


def sql_detect_columns():
    return with_views(*PRED_VIEWS, V_RUNS) + f"""
SELECT 'script=' || script || '/run=' || CAST(run AS VARCHAR) AS file, tp, fp, fn, tn,
       tp + fp + fn + tn AS n_total, CAST(NULL AS VARCHAR) AS error
FROM (SELECT script, run,
             CAST(count_if(g = 'yes' AND p = 'yes') AS BIGINT) AS tp, CAST(count_if(g = 'no' AND p = 'yes') AS BIGINT) AS fp,
             CAST(count_if(g = 'yes' AND p = 'no') AS BIGINT) AS fn, CAST(count_if(g = 'no' AND p = 'no') AS BIGINT) AS tn
      FROM (SELECT script, run, {label_eval('grammatical')} AS g, {label_eval('grammatical_pred')} AS p
            FROM runs WHERE run % 3 <> 2)
      GROUP BY script, run)
UNION ALL
SELECT DISTINCT 'script=' || script || '/run=' || CAST(run AS VARCHAR) AS file,
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       'Could not detect prediction column' AS error
FROM runs WHERE run % 3 = 2
UNION ALL SELECT 'script=odd/artifact=header{K.PREDICTIONS_SUFFIX}/run=0', 0, 0, 0, 0, 0, NULL
UNION ALL SELECT 'script=odd/artifact=empty{K.PREDICTIONS_SUFFIX}/run=0', NULL, NULL, NULL, NULL, NULL, 'No columns to parse from file'
UNION ALL SELECT 'script=odd/artifact=' || name || '{K.PREDICTIONS_SUFFIX}/run=0', NULL, NULL, NULL, NULL, NULL, error
FROM (VALUES ('quote', {lit(K.ERROR_OPEN_QUOTE)}), ('long', {lit(K.ERROR_TOO_MANY_FIELDS)}), ('bytes', {lit(K.ERROR_CHARSET)})) AS broken(name, error)
"""


def sql_sink_roundtrip():
    return (with_views(V_DOCS_EN, V_NP_ITEMS, V_BENCH)
            + "SELECT doc_id, pos, " + ", ".join(K.BENCHMARK_COLUMNS) + " FROM bench")


def sql_metrics_kv():
    def fmt6(c):
        return f"coalesce(printf('%.6f', {c}), 'nan')"

    items = [("model", lit("templates")), ("input", "input")]
    for c in ("n_total", "n_gold_yes", "n_gold_no", "tp_yes", "fp_yes", "fn_yes", "tp_no", "fp_no", "fn_no"):
        items.append((c, f"CAST({c} AS VARCHAR)"))
    for c in ("accuracy", "precision_yes", "recall_yes", "f1_yes", "precision_no", "recall_no", "f1_no", "macro_f1"):
        items.append((c, fmt6(c)))
    items.append(("mean_edit_distance_TP_no", "coalesce(CAST(mean_edit_distance_TP_no AS VARCHAR), 'nan')"))
    entries = ", ".join(f"{{'i': {i}, 'key': {lit(k)}, 'value': {v}}}" for i, (k, v) in enumerate(items))
    metrics = BENCH_METRICS_SELECT.strip()
    head, select = metrics.rsplit("\nSELECT input,", 1)
    return ("WITH " + ",\n".join(PRED_VIEWS) + ",\n" + head + ",\nm AS (SELECT input," + select + ")\n"
            + f"""SELECT input, CAST(e.i AS BIGINT) AS i, e.key AS key, e.key || '=' || e.value AS line
FROM (SELECT input, unnest([{entries}]) AS e FROM m)""")


def sql_metrics_json():
    return with_views(*RUN_VIEWS) + "SELECT script, run, tp, fp, fn, tn, n_total, precision, recall, f1, accuracy FROM per_run"


def sql_run_archive():
    return with_views(*RUN_VIEWS) + f"""
SELECT script, model, input, run, n_rows, f1, run AS seed, {ARTIFACT} AS predictions_file
FROM per_run JOIN (SELECT script, model, input, run, CAST(count(*) AS BIGINT) AS n_rows FROM runs GROUP BY ALL)
  USING (script, model, input, run)"""


def sql_run_files():
    # Counts by column (files read as CSV), F1 from raw lines (the mode of repeated runs).
    inner = _confusion_cols_sql("runs", "script, model, input, run", "grammatical", "grammatical_pred")
    model = "regexp_replace(model, '[^A-Za-z0-9._-]+', '_', 'g')"
    stem = "regexp_replace(script, '(.)[.][^.]*$', '\\1')"
    return with_views(*RUN_VIEWS, f"cc AS ({inner})") + f"""
SELECT 's0/' || {stem} || '/' || {model} || '__' || regexp_extract(input, '([^/]*)/*$', 1) || '/run_' || printf('%02d', run) AS folder,
       {ARTIFACT} AS name, cc.tp, cc.fp, cc.fn, cc.tn, per_run.f1, run AS seed
FROM cc JOIN per_run USING (script, model, input, run)"""


def sql_results_json():
    return with_views(*RUN_VIEWS) + """
SELECT script || '/' || run AS path, n_total AS n, f1 AS value FROM per_run
UNION ALL SELECT 'aggregate f1', CAST(count(f1) AS BIGINT), round(avg(f1), 6) FROM per_run"""


def sql_report_tags():
    return with_views(V_DOCS_EN, V_TOK) + f"""
SELECT unnest(['Sentence:' || s, 'Tags:' || t]) AS line FROM (
  SELECT string_agg(w, ' ' ORDER BY pos) AS s, string_agg(w || '/' || iob, ' ' ORDER BY pos) AS t
  FROM (SELECT doc_id, pos, w, {iob_tag(pos_tag('w'), pos_tag('p'))} AS iob FROM tok) GROUP BY doc_id)"""


def sql_report_text():
    return ("WITH " + ",\n".join(DETECT_VIEWS) + annotate_ctes()
            + "SELECT unnest(['Sentence:' || sentence, 'Output:' || output, '', '']) AS line FROM ann")




def _launch_text() -> str:
    nl = " || chr(10) || "
    variant = "ascii(right(source, 1)) % 3"
    model_arg = (f"(CASE {variant} WHEN 0 THEN 'org/model-' || source "
                 f"WHEN 1 THEN '\"org/model-' || source || '\"' "
                 f"ELSE '''org/model-' || source || '''' END)")
    sep = f"(CASE WHEN {variant} = 1 THEN '=' ELSE ' ' END)"
    return (
        "'#!/bin/bash'" + nl + "'#SBATCH --job-name=' || source" + nl + "'#SBATCH --time=24:00:00'" + nl
        + "'module load python'" + nl + "'cd $HOME/project'" + nl
        + "'python setup.py install --input=none'" + nl + r"'python3 score.py \'" + nl
        + "'    --model ' || " + model_arg + r" || ' \'" + nl
        + "'    --input' || " + sep + r" || 'data/' || source || '.csv \'" + nl
        + "'    --seed $SEED'" + nl + "'echo done'" + " || chr(10)"
    )


# The patterns of launch scripts in DuckDB's dialect.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"']+)""".replace("'", "''")
_COMMAND = r"(?:^|\n)\s*(?:python3?|/usr/bin/python[0-9.]*)\s+[^\\\n]*[^\s\\]*\.py[^\n]*--model[^\n]*"


def _arg(name: str) -> str:
    raw = f"regexp_extract(cmd, '--{name}(?:\\s+|=){_VALUE}', 1)"
    quoted = (f"(length({raw}) >= 2 AND ((starts_with({raw}, '\"') AND ends_with({raw}, '\"')) "
              f"OR (starts_with({raw}, '''') AND ends_with({raw}, ''''))))")
    return f"(CASE WHEN {quoted} THEN {raw}[2:length({raw}) - 1] ELSE {raw} END)"


def manifest_ctes() -> str:
    return f"""scripts AS (SELECT 'job_' || source || '.sh' AS script, {_launch_text()} AS text
                 FROM (SELECT DISTINCT source FROM documents)),
merged AS (SELECT script, regexp_replace(text, '\\\\[ \\t]*(?:\\r\\n|\\n|$)', ' ', 'g') AS m FROM scripts),
cmds AS (SELECT script, CASE WHEN regexp_matches(m, '{_COMMAND}') THEN regexp_extract(m, '{_COMMAND}', 0) ELSE m END AS cmd
         FROM merged),
args AS (SELECT script, {_arg('model')} AS model, {_arg('input')} AS inp FROM cmds),
manifest AS (
  SELECT script, CASE WHEN model <> '' AND inp <> '' THEN model END AS model,
         CASE WHEN model <> '' AND inp <> '' THEN regexp_extract(inp, '([^/]*)/*$', 1) END AS input,
         CASE WHEN model = '' THEN '--model not found in ' || script
              WHEN inp = '' THEN '--input not found in ' || script END AS error
  FROM args)"""


def sql_launch_manifest():
    return "WITH " + manifest_ctes() + "\nSELECT script, model, input, error FROM manifest"


def sql_manifest_join():
    return with_views(*PRED_VIEWS, V_RUNS, manifest_ctes(), f"""found AS (
  SELECT {ARTIFACT} AS artifact, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT run) AS BIGINT) AS n_runs
  FROM runs GROUP BY 1)""") + f"""
SELECT m.script, m.model, m.input, {M_ARTIFACT} AS artifact,
       coalesce(f.n_rows, 0) AS n_rows, coalesce(f.n_runs, 0) AS n_runs,
       CASE WHEN f.n_rows IS NULL THEN 'no predictions for ' || {M_ARTIFACT} END AS error
FROM (SELECT * FROM manifest WHERE error IS NULL) m LEFT JOIN found f ON f.artifact = {M_ARTIFACT}"""


def sql_stream_run_metrics():
    inner = _confusion_cols_sql("runs", "script, run", "grammatical", "grammatical_pred")
    return with_views(*PRED_VIEWS, V_RUNS, f"cc AS ({inner})", f"""pr AS (
  SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,
         {ratio('tp + tn', 'n_total')} AS accuracy FROM cc)""") + f"""
SELECT script, run, tp, fp, fn, tn, n_total, precision, recall, {f1('precision', 'recall')} AS f1, accuracy FROM pr"""


REGISTRY = {
    "scan_csv_quoted": sql_scan_csv_quoted,
    "scan_csv_encoding": sql_scan_csv_encoding,
    "tokenize_lines": sql_tokenize_lines,
    "dir_scan_confusion": sql_dir_scan_confusion,
    "detect_columns": sql_detect_columns,
    "sink_roundtrip": sql_sink_roundtrip,
    "metrics_kv": sql_metrics_kv,
    "metrics_json": sql_metrics_json,
    "results_json": sql_results_json,
    "summary_json": sql_metric_across_runs,
    "run_archive": sql_run_archive,
    "run_files": sql_run_files,
    "report_text": sql_report_text,
    "report_tags": sql_report_tags,
    "launch_manifest": sql_launch_manifest,
    "manifest_join": sql_manifest_join,
    "stream_run_metrics": sql_stream_run_metrics,
}
