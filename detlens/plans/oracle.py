"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written directly in SQL over the driver tables (windows, list functions and plain
aggregates; no attempt at scale). Column names match the Spark queries.
DuckDB dialect notes: RE2 regexes (no look-around, ASCII ``\\s``/``\\d``), 1-based lists,
``count_if``/``sum`` return HUGEINT (cast to BIGINT), ``/`` is float division.
"""

from __future__ import annotations

import re

from detlens import constants as K
from detlens.functions import prompts as PR


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# --- scalar SQL helpers ------------------------------------------------------
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


QUOTES_CLASS = "[" + K.QUOTE_CHARS.replace("'", "''") + "]"


def strip_quotes(x: str) -> str:
    return f"regexp_replace({x}, '^{QUOTES_CLASS}+|{QUOTES_CLASS}+$', '', 'g')"


def clean_text(x: str) -> str:
    t = rf"regexp_replace({strip('coalesce(' + x + ', ' + lit('') + ')')}, '\s+', ' ', 'g')"
    return f"(CASE WHEN lower({t}) IN {in_list(K.MISSING_TOKENS)} THEN '' ELSE {t} END)"


# The reference's patterns in DuckDB's dialect (see ``constants`` for Spark's).
NUMBERING = r"^\s*(?:\(?\d+\)?[.)-]\s*)"
BOILER = r"(?i)^\s*(?:followed by|is|should be|output(?: is)?|answer(?: is)?)\s+"
PUNCT = r"^\s*[,;:–—-]\s*"


def clean_fix(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    s = f"regexp_replace({s}, {lit(NUMBERING)}, '')"
    s = f"regexp_replace({s}, {lit(BOILER)}, '')"
    s = f"regexp_replace({s}, {lit(PUNCT)}, '')"
    return strip(strip_quotes(strip(s)))


def is_placeholder(x: str) -> str:
    t = f"lower({strip(x)})"
    return (f"({x} IS NULL OR {t} = '' OR {t} IN {in_list(K.PLACEHOLDERS)} "
            f"OR starts_with({t}, '<') OR ends_with({t}, '>'))")


def norm_np(x: str) -> str:
    t = f"lower({strip('coalesce(' + x + ', ' + lit('') + ')')})"
    t = strip(strip_quotes(t))
    t = f"regexp_replace({t}, '[.,;:]+$', '')"
    return rf"regexp_replace({t}, '\s+', ' ', 'g')"


def lower_stripped(x: str) -> str:
    return f"lower({strip('coalesce(CAST(' + x + ' AS VARCHAR), ' + lit('') + ')')})"


def label_strict(x: str) -> str:
    t = lower_stripped(x)
    return f"(CASE WHEN {t} IN {in_list(K.STRICT_YES)} THEN 'yes' WHEN {t} IN {in_list(K.STRICT_NO)} THEN 'no' ELSE {t} END)"


def label_wide(x: str) -> str:
    t = lower_stripped(x)
    return f"(CASE WHEN {t} IN {in_list(K.WIDE_YES)} THEN 'yes' WHEN {t} IN {in_list(K.WIDE_NO)} THEN 'no' ELSE '' END)"


def label_wide_pass(x: str) -> str:
    t = lower_stripped(x)
    return f"(CASE WHEN {t} IN {in_list(K.WIDE_YES)} THEN 'yes' WHEN {t} IN {in_list(K.WIDE_NO)} THEN 'no' ELSE {t} END)"


def label_eval(x: str, case_sensitive: bool = False) -> str:
    if case_sensitive:
        s = strip(f"CAST({x} AS VARCHAR)")
        body = f"CASE WHEN {s} IN ('a', 'A') THEN 'yes' WHEN {s} IN ('b', 'B') THEN 'no' ELSE {s} END"
    else:
        s = f"lower({strip('CAST(' + x + ' AS VARCHAR)')})"
        body = (f"CASE WHEN {s} = 'a' THEN 'yes' WHEN {s} = 'b' THEN 'no' "
                f"WHEN {s} IN {in_list(K.EVAL_EXTRA_YES)} THEN 'yes' WHEN {s} IN {in_list(K.EVAL_EXTRA_NO)} THEN 'no' ELSE {s} END")
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {body} END)"


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN NULL ELSE CAST({n} AS DOUBLE) / ({d}) END)"


def f1(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) = 0 THEN NULL ELSE 2.0 * ({p}) * ({r}) / (({p}) + ({r})) END)"


def pos_tag(x: str) -> str:
    parts = [f"WHEN {x} IN {in_list(words)} THEN {lit(tag)}" for tag, words in K.LEXICON]
    parts += [f"WHEN ends_with({x}, {lit(suf)}) THEN {lit(tag)}" for suf, tag in K.SUFFIX_RULES]
    return f"(CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {lit(K.DEFAULT_TAG)} END)"


def iob_tag(tag: str, prev_tag: str) -> str:
    np_set = in_list(K.NP_TAGS)
    in_np = f"coalesce({tag} IN {np_set}, false)"
    prev_in = f"coalesce({prev_tag} IN {np_set}, false)"
    return (f"(CASE WHEN {in_np} AND (NOT {prev_in} OR {tag} IN ('article', 'determiner')) THEN 'B-NP' "
            f"WHEN {in_np} THEN 'I-NP' ELSE 'O' END)")


def csv_field(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '[,\"\\r\\n]') "
            f"THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END)")


def classify(line: str, case_sensitive: bool = False) -> str:
    flag = "" if case_sensitive else "(?i)"
    parts = []
    for cls, g, p in (("tp", "yes", "yes"), ("fn", "yes", "no"), ("fp", "no", "yes"), ("tn", "no", "no")):
        pat = flag + rf",\s*{g}\s*,[^,]*,\s*{p}\s*(?:,|$)"
        parts.append(f"WHEN regexp_matches({line}, {lit(pat)}) THEN '{cls}'")
    return f"(CASE {' '.join(parts)} END)"


def reply_case(np_col: str, alt_col: str) -> str:
    branches = []
    for i, tpl in enumerate(K.REPLY_TEMPLATES):
        pieces = [p for p in re.split(r"(\{np\}|\{alt\})", tpl) if p != ""]
        if not pieces:
            expr = "''"
        else:
            expr = " || ".join(np_col if p == "{np}" else alt_col if p == "{alt}" else lit(p) for p in pieces)
        branches.append(f"WHEN {i} THEN {expr}")
    return f"(CASE (doc_id * 31 + pos) % {len(K.REPLY_TEMPLATES)} {' '.join(branches)} END)"


# --- views -------------------------------------------------------------------
V_DOCS_EN = r"""docs_en AS (
  SELECT doc_id, source, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE lang = 'en')"""

V_DOCS_ALL = V_DOCS_EN.replace(" WHERE lang = 'en'", "")

V_TOK = """tok AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(i - 1 AS BIGINT) AS pos,
         ws[i] AS w, ws[i - 1] AS p, ws[i + 1] AS n
  FROM (SELECT doc_id, source, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs_en))"""

V_NP_ITEMS = """np_items AS (
  SELECT doc_id, source, pos, w, n, sentence, w || ' ' || n AS noun_phrase, alt,
         CASE (doc_id + pos) % 4 WHEN 0 THEN n WHEN 1 THEN alt WHEN 2 THEN '' ELSE 'NaN' END AS gold_fix
  FROM (
    SELECT doc_id, source, CAST(i - 1 AS BIGINT) AS pos, ws[i] AS w, ws[i + 1] AS n,
           array_to_string(ws[greatest(i - 5, 1):least(i + 5, len(ws))], ' ') AS sentence,
           (CASE WHEN ws[i] = 'the' THEN 'a' ELSE 'the' END) || ' ' || ws[i + 1] AS alt
    FROM (SELECT doc_id, source, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs_en))
  WHERE w IN ('the', 'a', 'an') AND regexp_full_match(n, '[a-z]+'))"""

V_BENCH = f"""bench AS (
  SELECT doc_id, source, pos, alt, sentence, noun_phrase,
         {label_strict("CASE WHEN length(fix) > 0 THEN 'no' ELSE 'yes' END")} AS grammatical,
         CASE WHEN length(fix) > 0 THEN fix ELSE noun_phrase END AS corrected
  FROM (SELECT doc_id, source, pos, alt, {clean_text('sentence')} AS sentence,
               {clean_text('noun_phrase')} AS noun_phrase, {clean_text('gold_fix')} AS fix FROM np_items))"""

V_REPLIES = f"""replies AS (SELECT *, {reply_case('noun_phrase', 'alt')} AS reply FROM bench)"""

# Patterns of replies, as above.
ANSWER = r"(?i)^\s*\**\s*answer\s*[:\-]*\s*"
ECHO = " OR ".join(f"starts_with(lower(l), {lit(p)})" for p in K.ECHO_PREFIXES)
VERDICT_CASE = (
    r"CASE WHEN regexp_matches(l, '(?i)^\s*yes') THEN 'yes' WHEN regexp_matches(l, '(?i)^\s*no') THEN 'no' "
    r"WHEN regexp_matches(l, '(?i)^\s*a') THEN 'yes' WHEN regexp_matches(l, '(?i)^\s*b') THEN 'no' END"
)
AFTER_CASE = (
    r"CASE WHEN regexp_matches(l, '(?i)^\s*yes') THEN regexp_extract(l, '(?is)^\s*yes\s*[:\-]?\s*(.*)$', 1) "
    r"WHEN regexp_matches(l, '(?i)^\s*no') THEN regexp_extract(l, '(?is)^\s*no\s*[:\-]?\s*(.*)$', 1) "
    r"WHEN regexp_matches(l, '(?i)^\s*a') THEN regexp_extract(l, '(?is)^\s*a\s*[:\-]?\s*(.*)$', 1) "
    r"WHEN regexp_matches(l, '(?i)^\s*b') THEN regexp_extract(l, '(?is)^\s*b\s*[:\-]?\s*(.*)$', 1) END"
)
FALLBACK = r"(?is)(?:^|[^\pL\pN_])(yes|no)((?:[^\pL\pN_].*)?)$"

PARSED_EXPR = (
    "list_filter(list_transform(list_transform(list_filter(list_transform("
    r"string_split_regex(split_part(txt, '<EOT>', 1), '\r\n|[\n\r]'), lambda l: " + strip("l") + "), "
    f"lambda l: l <> '' AND NOT ({ECHO})), "
    f"lambda l: regexp_replace(regexp_replace(l, {lit(ANSWER)}, ''), {lit(NUMBERING)}, '')), "
    f"lambda l: {{'v': {VERDICT_CASE}, 'a': {AFTER_CASE}}}), lambda s: s.v IS NOT NULL)[1]"
)

V_PARSED = f"""parsed AS (
  SELECT *, {PARSED_EXPR} AS pr,
         regexp_matches(txt, {lit(FALLBACK)}) AS fb_found,
         lower(regexp_extract(txt, {lit(FALLBACK)}, 1)) AS fb_v,
         {strip("split_part(regexp_replace(regexp_extract(txt, " + lit(FALLBACK) + r", 2), '^[:\-]?\s*', ''), chr(10), 1)")} AS fb_f
  FROM (SELECT *, CASE WHEN contains(rt, '<EOT>') THEN rt ELSE rt || '<EOT>' END AS txt
        FROM (SELECT *, {strip("coalesce(reply, '')")} AS rt FROM replies)))"""

V_PREDS = f"""decided AS (
  SELECT *, CASE WHEN coalesce(pr.v, '') IN ('yes', 'no') THEN pr.v WHEN fb_found THEN fb_v ELSE 'yes' END AS yn1,
         {clean_fix("CASE WHEN coalesce(pr.v, '') IN ('yes', 'no') THEN " + clean_fix('pr.a') + " WHEN fb_found THEN fb_f ELSE '' END")} AS fx1
  FROM parsed),
placeheld AS (
  SELECT *, CASE WHEN yn1 = 'no' AND {is_placeholder('fx1')} THEN '' ELSE fx1 END AS fx2 FROM decided),
demoted AS (
  SELECT *, (yn1 = 'no' AND ({norm_np('fx2')} = '' OR {norm_np('fx2')} = {norm_np('noun_phrase')})) AS dm FROM placeheld),
preds AS (
  SELECT doc_id, source, pos, sentence, noun_phrase, {label_wide_pass('grammatical')} AS grammatical, corrected,
         CASE WHEN dm THEN 'yes' ELSE yn1 END AS grammatical_pred,
         CASE WHEN NOT dm AND yn1 = 'no' THEN fx2 ELSE coalesce(noun_phrase, '') END AS correction,
         CASE WHEN NOT dm AND yn1 = 'no' THEN fx2 ELSE '' END AS fix_pred
  FROM demoted)"""

RUN_COLS = ("'job_' || source || '.sh' AS script, 'org/model-' || source AS model, source || '.csv' AS input, "
            "CAST(pos % 10 + 1 AS BIGINT) AS run")
V_RUNS = f"runs AS (SELECT {RUN_COLS}, * FROM preds)"
V_LINES = ("lines AS (SELECT script, model, input, run, doc_id, pos, "
           + " || ',' || ".join(csv_field(c) for c in K.PREDICTION_TABLE_COLUMNS) + " AS line FROM runs)")
V_PER_RUN = f"""cls AS (SELECT *, {classify('line')} AS cls FROM lines),
counts AS (
  SELECT script, model, input, run,
         CAST(count_if(cls = 'tp') AS BIGINT) AS tp, CAST(count_if(cls = 'fp') AS BIGINT) AS fp,
         CAST(count_if(cls = 'fn') AS BIGINT) AS fn, CAST(count_if(cls = 'tn') AS BIGINT) AS tn
  FROM cls GROUP BY script, model, input, run),
pr_run AS (SELECT *, tp + fp + fn + tn AS n_total, {ratio('tp', 'tp + fp')} AS precision,
                  {ratio('tp', 'tp + fn')} AS recall, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM counts),
per_run AS (SELECT *, {f1('precision', 'recall')} AS f1 FROM pr_run)"""

V_LAB = """lab AS (
  SELECT l.doc_id, d.source, CAST(l.quality AS VARCHAR) AS grammatical,
         CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END AS grammatical_pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

V_LM = f"""trans AS (SELECT * FROM tok WHERE n IS NOT NULL),
bigrams AS (SELECT w, n, CAST(count(*) AS BIGINT) AS c FROM trans GROUP BY w, n),
vocab AS (SELECT CAST(count(DISTINCT w) AS BIGINT) AS v FROM tok),
wstat AS (SELECT w, CAST(sum(c) AS BIGINT) AS cw,
                 CAST(coalesce(max(CASE WHEN n = {lit(K.INSERTED_DETERMINER)} THEN c END), 0) AS BIGINT) AS c_w_ins
          FROM bigrams GROUP BY w),
ranked AS (SELECT w, n, c, row_number() OVER (PARTITION BY w ORDER BY c DESC, n ASC) AS rk FROM bigrams),
top AS (SELECT * FROM ranked WHERE rk <= {K.TOP_NEXT_WORDS}),
tstat AS (SELECT w, {', '.join(f"CAST(coalesce(max(CASE WHEN n = {lit(d)} THEN c END), 0) AS BIGINT) AS top_{d}" for d in K.DETERMINERS)}
          FROM top GROUP BY w),
pairs AS (SELECT b.w, b.n, b.c, s.cw, s.c_w_ins, (t.rk IS NOT NULL) AS in_top,
                 {', '.join(f"coalesce(ts.top_{d}, 0) AS top_{d}" for d in K.DETERMINERS)}
          FROM bigrams b JOIN wstat s ON b.w = s.w LEFT JOIN top t ON b.w = t.w AND b.n = t.n
          LEFT JOIN tstat ts ON b.w = ts.w),
c_ins AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS c_ins FROM bigrams WHERE w = {lit(K.INSERTED_DETERMINER)})"""


def lp(c: str, cw: str) -> str:
    return (f"CAST(floor(1e6 * ln((coalesce({c}, 0) + 1) / (coalesce({cw}, 0) + (SELECT v FROM vocab))) + 0.5) AS BIGINT)")


def ppl_centi(s: str, m: str) -> str:
    return f"(CASE WHEN ({m}) > 0 THEN CAST(floor(exp(-({s}) / 1e6 / ({m})) * 100.0 + 0.5) AS BIGINT) END)"


TRIG = " OR ".join(f"trig_{d}" for d in K.DETERMINERS)
V_DETECT = f"""scored AS (
  SELECT t.doc_id, t.pos, t.w, t.n, t.p, t.n_words, pr.c, pr.cw, pr.c_w_ins, pr.in_top,
         {', '.join(f'pr.top_{d}' for d in K.DETERMINERS)}, {lp('pr.c', 'pr.cw')} AS lp
  FROM trans t JOIN pairs pr ON t.w = pr.w AND t.n = pr.n),
sfx AS (SELECT *, CAST(sum(lp) OVER (PARTITION BY doc_id ORDER BY pos
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS sfx_lp,
               CASE WHEN in_top THEN c ELSE 0 END AS c_top_n FROM scored),
cand0 AS (
  SELECT *, {', '.join(f"(top_{d} > c_top_n AND {pos_tag('n')} IN {in_list(K.MISSING_TRIGGER_TAGS)}) AS trig_{d}" for d in K.DETERMINERS)},
         ({pos_tag('w')} IN {in_list(K.DETERMINER_TAGS)} AND {pos_tag('n')} <> 'noun') AS trig_extra
  FROM sfx),
cand AS (
  SELECT c.*, ins.c AS c_ins_n, pw.c AS c_pw, pw.cw AS cw_p, pn.c AS c_pn
  FROM (SELECT * FROM cand0 WHERE trig_extra OR {TRIG}) c
  LEFT JOIN (SELECT n, c FROM bigrams WHERE w = {lit(K.INSERTED_DETERMINER)}) ins ON c.n = ins.n
  LEFT JOIN pairs pw ON c.p = pw.w AND c.w = pw.n
  LEFT JOIN pairs pn ON c.p = pn.w AND c.n = pn.n),
ppl AS (
  SELECT doc_id, pos, w, n, {', '.join(f'trig_{d}' for d in K.DETERMINERS)}, trig_extra,
         {ppl_centi('sfx_lp', 'n_words - 1 - pos')} AS m_ppl1,
         {ppl_centi('sfx_lp - lp + ' + lp('c_w_ins', 'cw') + ' + ' + lp('c_ins_n', '(SELECT c_ins FROM c_ins)'), 'n_words - pos')} AS m_ppl2,
         CASE WHEN pos = 0 THEN {ppl_centi('sfx_lp', 'n_words - 1')}
              ELSE {ppl_centi('sfx_lp + ' + lp('c_pw', 'cw_p'), 'n_words - pos')} END AS e_ppl1,
         CASE WHEN pos = 0 THEN {ppl_centi('sfx_lp - lp', 'n_words - 2')}
              ELSE {ppl_centi('sfx_lp - lp + ' + lp('c_pn', 'cw_p'), 'n_words - 1 - pos')} END AS e_ppl2
  FROM cand),
flags AS (
  SELECT *, {', '.join(f"(trig_{d} AND coalesce(m_ppl1 > m_ppl2, false)) AS missing_{d}" for d in K.DETERMINERS)}
  FROM ppl),
flags2 AS (
  SELECT *, (NOT ({' OR '.join(f'missing_{d}' for d in K.DETERMINERS)}) AND trig_extra
             AND coalesce(e_ppl1 > e_ppl2, false)) AS extra
  FROM flags)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


PRED_VIEWS = (V_DOCS_EN, V_NP_ITEMS, V_BENCH, V_REPLIES, V_PARSED, V_PREDS)
RUN_VIEWS = PRED_VIEWS + (V_RUNS, V_LINES, V_PER_RUN)
LM_VIEWS = (V_DOCS_ALL, V_TOK, V_LM)
DETECT_VIEWS = (V_DOCS_EN, V_TOK, V_LM, V_DETECT)

BENCH_METRICS_SELECT = f"""
agg AS (
  SELECT source AS input, CAST(count(*) AS BIGINT) AS n_total,
         CAST(count_if(t = 'yes') AS BIGINT) AS n_gold_yes, CAST(count_if(t = 'no') AS BIGINT) AS n_gold_no,
         CAST(count_if(t = 'yes' AND p = 'yes') AS BIGINT) AS tp_yes,
         CAST(count_if(t <> 'yes' AND p = 'yes') AS BIGINT) AS fp_yes,
         CAST(count_if(t = 'yes' AND p <> 'yes') AS BIGINT) AS fn_yes,
         CAST(count_if(t = 'no' AND p = 'no') AS BIGINT) AS tp_no,
         CAST(count_if(t <> 'no' AND p = 'no') AS BIGINT) AS fp_no,
         CAST(count_if(t = 'no' AND p <> 'no') AS BIGINT) AS fn_no,
         CAST(count_if(t <> '' AND p <> '' AND t = p) AS BIGINT) AS n_correct,
         avg(CASE WHEN t = 'no' AND p = 'no' THEN levenshtein({strip('corrected')}, {strip('fix_pred')}) END)
           AS mean_edit_distance_TP_no
  FROM (SELECT *, {label_wide('grammatical')} AS t, grammatical_pred AS p FROM preds) GROUP BY source),
r AS (
  SELECT *, {ratio('n_correct', 'n_total')} AS accuracy,
         {ratio('tp_yes', 'tp_yes + fp_yes')} AS precision_yes, {ratio('tp_yes', 'tp_yes + fn_yes')} AS recall_yes,
         {ratio('tp_no', 'tp_no + fp_no')} AS precision_no, {ratio('tp_no', 'tp_no + fn_no')} AS recall_no
  FROM agg),
f AS (SELECT *, {f1('precision_yes', 'recall_yes')} AS f1_yes, {f1('precision_no', 'recall_no')} AS f1_no FROM r)
SELECT input, n_total, n_gold_yes, n_gold_no, tp_yes, fp_yes, fn_yes, tp_no, fp_no, fn_no, accuracy,
       precision_yes, recall_yes, f1_yes, precision_no, recall_no, f1_no,
       coalesce((f1_yes + f1_no) / 2.0, f1_yes, f1_no) AS macro_f1, mean_edit_distance_TP_no
FROM f"""


def sql_benchmark_metrics():
    return "WITH " + ",\n".join(PRED_VIEWS) + ",\n" + BENCH_METRICS_SELECT.strip()


def sql_confusion_per_class():
    return with_views(*PRED_VIEWS) + f"""
SELECT source AS input, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count_if(t = 'yes') AS BIGINT) AS n_gold_yes, CAST(count_if(t = 'no') AS BIGINT) AS n_gold_no,
       CAST(count_if(t = 'yes' AND p = 'yes') AS BIGINT) AS tp_yes,
       CAST(count_if(t <> 'yes' AND p = 'yes') AS BIGINT) AS fp_yes,
       CAST(count_if(t = 'yes' AND p <> 'yes') AS BIGINT) AS fn_yes,
       CAST(count_if(t = 'no' AND p = 'no') AS BIGINT) AS tp_no,
       CAST(count_if(t <> 'no' AND p = 'no') AS BIGINT) AS fp_no,
       CAST(count_if(t = 'no' AND p <> 'no') AS BIGINT) AS fn_no,
       CAST(count_if(t <> '' AND p <> '' AND t = p) AS BIGINT) AS n_correct
FROM (SELECT *, {label_wide('grammatical')} AS t, grammatical_pred AS p FROM preds) GROUP BY source"""


def _confusion_cols_sql(src: str, group: str, g: str, p: str) -> str:
    return f"""SELECT {group}, tp, fp, fn, tn, tp + fp + fn + tn AS n_total FROM (
  SELECT {group},
         CAST(count_if(g = 'yes' AND p = 'yes') AS BIGINT) AS tp, CAST(count_if(g = 'no' AND p = 'yes') AS BIGINT) AS fp,
         CAST(count_if(g = 'yes' AND p = 'no') AS BIGINT) AS fn, CAST(count_if(g = 'no' AND p = 'no') AS BIGINT) AS tn
  FROM (SELECT *, {label_eval(g)} AS g, {label_eval(p)} AS p FROM {src}) GROUP BY {group})"""


def sql_confusion_columns():
    return with_views(V_LAB) + _confusion_cols_sql("lab", "source", "grammatical", "grammatical_pred")


def sql_prf_accuracy():
    inner = _confusion_cols_sql("(SELECT source AS input, * FROM preds)", "input", "grammatical", "grammatical_pred")
    return with_views(*PRED_VIEWS, f"cc AS ({inner})", f"""pr AS (SELECT *, {ratio('tp', 'tp + fp')} AS precision,
       {ratio('tp', 'tp + fn')} AS recall, {ratio('tp + tn', 'n_total')} AS accuracy FROM cc)""") + f"""
SELECT input, tp, fp, fn, tn, n_total, precision, recall, {f1('precision', 'recall')} AS f1, accuracy FROM pr"""


def sql_macro_f1():
    return with_views(V_LAB) + f"""
, agg AS (
  SELECT source, CAST(count_if(t = 'yes' AND p = 'yes') AS BIGINT) AS tp_yes,
         CAST(count_if(t <> 'yes' AND p = 'yes') AS BIGINT) AS fp_yes,
         CAST(count_if(t = 'yes' AND p <> 'yes') AS BIGINT) AS fn_yes,
         CAST(count_if(t = 'no' AND p = 'no') AS BIGINT) AS tp_no,
         CAST(count_if(t <> 'no' AND p = 'no') AS BIGINT) AS fp_no,
         CAST(count_if(t = 'no' AND p <> 'no') AS BIGINT) AS fn_no
  FROM (SELECT *, {label_wide('grammatical')} AS t, {label_wide('grammatical_pred')} AS p FROM lab) GROUP BY source),
r AS (SELECT *, {ratio('tp_yes', 'tp_yes + fp_yes')} AS py, {ratio('tp_yes', 'tp_yes + fn_yes')} AS ry,
             {ratio('tp_no', 'tp_no + fp_no')} AS pn, {ratio('tp_no', 'tp_no + fn_no')} AS rn FROM agg),
f AS (SELECT source, {f1('py', 'ry')} AS f1_yes, {f1('pn', 'rn')} AS f1_no FROM r)
SELECT source, f1_yes, f1_no, coalesce((f1_yes + f1_no) / 2.0, f1_yes, f1_no) AS macro_f1 FROM f"""


def sql_confusion_regex():
    return with_views(*RUN_VIEWS) + "SELECT script, run, tp, fp, fn, tn, n_total FROM per_run"


def sql_metric_across_files():
    return with_views(*RUN_VIEWS) + """
SELECT script, CAST(count(*) AS BIGINT) AS count, CAST(count(f1) AS BIGINT) AS used, 'f1' AS metric,
       round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std
FROM per_run GROUP BY script"""


def sql_metric_across_runs():
    parts = ["CAST(count(*) AS BIGINT) AS runs"]
    for m in K.METRIC_NAMES:
        parts.append(f"round(avg({m}), 6) AS {m}_mean")
        parts.append(f"round(stddev_pop({m}), 6) AS {m}_std")
    for c in K.CONFUSION_NAMES:
        parts.append(f"CAST(sum({c}) AS BIGINT) AS {c}_sum")
    for c in K.CONFUSION_NAMES:
        parts.append(f"CAST(sum({c}) AS DOUBLE) / count(*) AS {c}_mean")
    return with_views(*RUN_VIEWS) + f"SELECT script, model, input, {', '.join(parts)} FROM per_run GROUP BY script, model, input"


def sql_run_table_with_summary():
    ms = ", ".join(K.METRIC_NAMES)
    mean = ", ".join(f"round(avg({m}), 6) AS {m}" for m in K.METRIC_NAMES)
    std = ", ".join(f"round(stddev_pop({m}), 6) AS {m}" for m in K.METRIC_NAMES)
    return with_views(*RUN_VIEWS) + f"""
SELECT script, CAST(run AS VARCHAR) AS run, {ms} FROM per_run
UNION ALL SELECT script, 'mean' AS run, {mean} FROM per_run GROUP BY script
UNION ALL SELECT script, 'std' AS run, {std} FROM per_run GROUP BY script"""


def sql_clean_text():
    return f"SELECT doc_id, {clean_text('text')} AS clean FROM documents"


RAW_WORDS = r"""raw_words AS (
  SELECT doc_id, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos, unnest(ws) AS raw
  FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS ws FROM documents))"""


def sql_label(fn, name="label"):
    return with_views(RAW_WORDS) + f"SELECT doc_id, pos, {fn('raw')} AS {name} FROM raw_words"


def sql_label_eval():
    return with_views(RAW_WORDS) + f"SELECT doc_id, pos, {label_eval('raw')} AS label, {label_eval('raw', True)} AS label_cs FROM raw_words"


def sql_format_benchmark():
    return with_views(V_DOCS_EN, V_NP_ITEMS, V_BENCH) + "SELECT doc_id, pos, sentence, noun_phrase, grammatical, corrected FROM bench"


def sql_parse_reply():
    return with_views(*PRED_VIEWS[:5]) + f"""
SELECT doc_id, pos, coalesce(pr.v, '') AS verdict,
       CASE WHEN pr.v IS NOT NULL THEN {clean_fix('pr.a')} ELSE '' END AS fix FROM parsed"""


def sql_reply_verdict():
    return with_views(*PRED_VIEWS[:5]) + """
SELECT doc_id, pos, fb_found AS found, CASE WHEN fb_found THEN fb_v END AS verdict,
       CASE WHEN fb_found THEN coalesce(fb_f, '') END AS fix FROM parsed"""


def sql_clean_fix():
    return with_views(*PRED_VIEWS[:4]) + f"SELECT doc_id, pos, {clean_fix('reply')} AS fix FROM replies"


def sql_is_placeholder():
    return with_views(*PRED_VIEWS[:4]) + f"SELECT doc_id, pos, {is_placeholder('reply')} AS placeholder FROM replies"


def sql_final_verdict():
    return with_views(*PRED_VIEWS) + "SELECT doc_id, pos, " + ", ".join(K.PREDICTION_TABLE_COLUMNS) + " FROM preds"


def sql_artifact_key():
    key = (r"regexp_replace(model, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || "
           r"regexp_extract(input, '([^/]*)/*$', 1) || " + lit(K.PREDICTIONS_SUFFIX))
    return with_views(*PRED_VIEWS, V_RUNS) + f"SELECT script, model, input, {key} AS artifact FROM (SELECT DISTINCT script, model, input FROM runs)"


def sql_edit_distance():
    return with_views(*PRED_VIEWS) + f"SELECT doc_id, pos, CAST(levenshtein({strip('corrected')}, {strip('correction')}) AS BIGINT) AS distance FROM preds"


def sql_build_prompt():
    head = lit(PR.JUDGE_INSTRUCTIONS + "\n\n" + 'Sentence: "')
    mid = lit('"\nNoun phrase: "')
    tail = lit('"\n' + PR.JUDGE_ASK)
    return with_views(V_DOCS_EN, V_NP_ITEMS, V_BENCH) + f"SELECT doc_id, pos, {head} || sentence || {mid} || noun_phrase || {tail} AS prompt FROM bench"


def sql_classify_line():
    return with_views(*PRED_VIEWS, V_RUNS, V_LINES) + f"SELECT doc_id, pos, {classify('line')} AS cls, {classify('line', True)} AS cls_cs FROM lines"


def sql_batch_score():
    return with_views(*PRED_VIEWS[:4]) + "SELECT doc_id, pos, reply FROM replies"


def sql_neighbour_words():
    return with_views(V_DOCS_ALL, V_TOK) + "SELECT doc_id, pos, w, p, n FROM tok"


def sql_next_word_model():
    return with_views(*LM_VIEWS) + f"SELECT b.w, b.n, b.c, s.cw, {lp('b.c', 's.cw')} AS lp FROM bigrams b JOIN wstat s ON b.w = s.w"


def sql_topk_next_word():
    return with_views(*LM_VIEWS) + """
SELECT t.w, t.n, t.c, CAST(t.c AS DOUBLE) / s.cw AS p, CAST(t.rk AS BIGINT) AS rk FROM top t JOIN wstat s ON t.w = s.w"""


def sql_perplexity():
    return with_views(*LM_VIEWS) + f"""
, scored AS (SELECT t.doc_id, {lp('pr.c', 'pr.cw')} AS lp FROM trans t JOIN pairs pr ON t.w = pr.w AND t.n = pr.n)
SELECT doc_id, n_transitions, sum_lp, {ppl_centi('sum_lp', 'n_transitions')} / 100.0 AS perplexity
FROM (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_transitions, CAST(sum(lp) AS BIGINT) AS sum_lp FROM scored GROUP BY doc_id)"""


def sql_pos_tags():
    return with_views(V_DOCS_EN, V_TOK) + f"SELECT doc_id, pos, w, {pos_tag('w')} AS tag FROM tok"


def sql_iob_tags():
    return with_views(V_DOCS_EN, V_TOK) + f"SELECT doc_id, pos, w, {iob_tag(pos_tag('w'), pos_tag('p'))} AS iob FROM tok"


def sql_missing_determiner():
    parts = [
        f"SELECT doc_id, pos, w, n, {lit(d)} AS det, m_ppl1 / 100.0 AS ppl1, m_ppl2 / 100.0 AS ppl2 FROM flags2 WHERE missing_{d}"
        for d in K.DETERMINERS
    ]
    return with_views(*DETECT_VIEWS) + "\nUNION ALL\n".join(parts)


def sql_extra_determiner():
    return with_views(*DETECT_VIEWS) + "SELECT doc_id, pos, w, n, e_ppl1 / 100.0 AS ppl1, e_ppl2 / 100.0 AS ppl2 FROM flags2 WHERE extra"


def annotate_ctes() -> str:
    """CTE list (after the detector views) ending in ``ann(doc_id, sentence, output)``."""
    marker = " || ".join(
        [f"CASE WHEN missing_{d} THEN {lit(f' [MISSING DET:{d}] ')} ELSE '' END" for d in K.DETERMINERS]
        + ["CASE WHEN extra THEN ' [EXTRA DET:' || w || '] ' ELSE '' END"]
    )
    return f""",
marks AS (SELECT doc_id, pos, {marker} AS marker FROM flags2),
ann AS (
  SELECT t.doc_id AS doc_id,
         string_agg(' ' || t.w, '' ORDER BY t.pos) AS sentence,
         string_agg(' ' || t.w || coalesce(m.marker, ''), '' ORDER BY t.pos) AS output
  FROM tok t LEFT JOIN marks m ON t.doc_id = m.doc_id AND t.pos = m.pos
  GROUP BY t.doc_id)
"""


def sql_annotate():
    return "WITH " + ",\n".join(DETECT_VIEWS) + annotate_ctes() + "SELECT doc_id, sentence, output FROM ann"


def sql_parse_pos_reply():
    # The reply round-trips through upper-casing and a leading underscore; parsing
    # lower-cases and strips them, so the tags equal the rule tagger's.
    return with_views(V_DOCS_EN, V_TOK) + f"SELECT doc_id, pos, w, {pos_tag('w')} AS tag FROM tok"


def sql_parse_iob_reply():
    return with_views(V_DOCS_EN, V_TOK) + f"SELECT doc_id, pos, w, {iob_tag(pos_tag('w'), pos_tag('p'))} AS iob FROM tok"


def sql_detect_with_tags():
    # The replies spell words in their own way; tags are bound by position, so they are the rule tagger's.
    return sql_missing_determiner()


def sql_detect_with_model():
    def number(x, digits):
        return f"CAST('0x' || substr(md5({x}), 1, {digits}) AS BIGINT)"

    def prob(word):
        return (f"(CASE WHEN {word} IN {in_list(K.STAND_IN_VOCABULARY)} THEN {number(f"w || '/' || {word}", 6)} "
                f"/ {float(len(K.STAND_IN_VOCABULARY) << 24)} ELSE 0.0 END)")

    def ppl(x):
        return f"(CASE WHEN contains({x}, ' ') THEN round(1 + {number(x, 7)} % 100000 / 100.0, 2) END)"

    likely = {d: f"{prob(lit(d))} > {prob('n')} AND {pos_tag('n')} IN ('noun', 'adjective')" for d in K.DETERMINERS}
    fired = " OR ".join(f"missing_{d}" for d in K.DETERMINERS)
    return f"""
WITH s AS (SELECT doc_id, string_split_regex(lower(text), '[.!?\n]+') AS parts FROM documents WHERE lang = 'en' AND text IS NOT NULL),
l AS (SELECT doc_id || ':' || (i - 1) AS doc_id, regexp_extract_all(parts[i], '\\p{{L}}+') AS ws
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)),
t AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ws[i] AS w, ws[i + 1] AS n, CASE WHEN i > 1 THEN ws[i - 1] || ' ' ELSE '' END AS p,
             array_to_string(ws[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM l)),
m AS (SELECT *, {', '.join(f"{c} AS trig_{d}" for d, c in likely.items())}, {ppl("(w || ' ' || rest)")} AS m1, {ppl("(w || ' the ' || rest)")} AS m2,
             {ppl("(p || w || ' ' || rest)")} AS e1, {ppl('(p || rest)')} AS e2 FROM t),
f AS (SELECT *, {', '.join(f"trig_{d} AND coalesce(m1 > m2, false) AS missing_{d}" for d in K.DETERMINERS)} FROM m)
""" + "\nUNION ALL\n".join(
        [f"SELECT doc_id, pos, w, n, {lit(d)} AS det, m1 AS ppl1, m2 AS ppl2 FROM f WHERE missing_{d}" for d in K.DETERMINERS]
        + [f"SELECT doc_id, pos, w, n, CAST(NULL AS VARCHAR) AS det, e1 AS ppl1, e2 AS ppl2 FROM f "
           f"WHERE NOT ({fired}) AND {pos_tag('w')} IN {in_list(K.DETERMINER_TAGS)} AND {pos_tag('n')} <> 'noun' AND e1 > e2"])


REGISTRY = {
    "benchmark_metrics": sql_benchmark_metrics,
    "confusion_per_class": sql_confusion_per_class,
    "confusion_columns": sql_confusion_columns,
    "prf_accuracy": sql_prf_accuracy,
    "macro_f1": sql_macro_f1,
    "confusion_regex": sql_confusion_regex,
    "metric_across_files": sql_metric_across_files,
    "metric_across_runs": sql_metric_across_runs,
    "run_table_with_summary": sql_run_table_with_summary,
    "clean_text": sql_clean_text,
    "label_strict": lambda: sql_label(label_strict),
    "label_wide": lambda: sql_label(label_wide),
    "label_wide_pass": lambda: sql_label(label_wide_pass),
    "label_eval": sql_label_eval,
    "format_benchmark": sql_format_benchmark,
    "parse_reply": sql_parse_reply,
    "reply_verdict": sql_reply_verdict,
    "clean_fix": sql_clean_fix,
    "is_placeholder": sql_is_placeholder,
    "final_verdict": sql_final_verdict,
    "artifact_key": sql_artifact_key,
    "edit_distance": sql_edit_distance,
    "build_prompt": sql_build_prompt,
    "classify_line": sql_classify_line,
    "batch_score": sql_batch_score,
    "neighbour_words": sql_neighbour_words,
    "next_word_model": sql_next_word_model,
    "topk_next_word": sql_topk_next_word,
    "perplexity": sql_perplexity,
    "pos_tags": sql_pos_tags,
    "iob_tags": sql_iob_tags,
    "missing_determiner": sql_missing_determiner,
    "extra_determiner": sql_extra_determiner,
    "annotate": sql_annotate,
    "detect_with_tags": sql_detect_with_tags,
    "detect_with_model": sql_detect_with_model,
    "parse_pos_reply": sql_parse_pos_reply,
    "parse_iob_reply": sql_parse_iob_reply,
}


def all_sql() -> dict[str, str]:
    from detlens.plans import oracle_io

    merged = dict(REGISTRY)
    merged.update(oracle_io.REGISTRY)
    return {name: fn() for name, fn in merged.items()}
