"""Parsing free-text model replies into columns.

Everything is written with Spark's higher-order array functions and regexes, so a
reply is parsed by JVM expressions, with no Python in the loop. (Lambda functions are
evaluated without code generation, but stay in the executor's JVM.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.text import (
    LINE_BREAK, NUMBERING, clean_fix, col, is_placeholder, norm_np, pattern, py_strip,
)

_ANSWER_PREFIX = pattern(K.PAT_ANSWER_PREFIX)
# The verdict that a line begins with (group 1, the first word in order that fits) and what follows it (group 2).
_VERDICT = pattern(K.PAT_VERDICT, word="(" + "|".join(word for word, _ in K.VERDICT_WORDS) + ")")
# Fallback: the first stand-alone yes/no anywhere; the rest of that line is the fix.
_FALLBACK = pattern(K.PAT_FALLBACK)


def reply_text(reply) -> Column:
    """The decoded reply, stripped, with the stop marker appended when absent."""
    t = py_strip(F.coalesce(col(reply), F.lit("")))
    return F.when(t.contains(K.STOP_MARKER), t).otherwise(F.concat(t, F.lit(K.STOP_MARKER)))


def reply_lines(text) -> Column:
    """Non-blank stripped lines before the stop marker, echo lines removed."""
    cut = F.substring_index(col(text), K.STOP_MARKER, 1)
    lines = F.transform(F.split(cut, LINE_BREAK), py_strip)

    echo = r"\A(?:" + "|".join(re.escape(prefix) for prefix in K.ECHO_PREFIXES) + ")"
    return F.filter(lines, lambda line: (line != "") & ~F.lower(line).rlike(echo))


def verdict_line(text) -> Column:
    """The first line that begins with a verdict, without what stands before that; NULL when none does."""
    plain = F.transform(reply_lines(text), lambda line: F.regexp_replace(F.regexp_replace(line, _ANSWER_PREFIX, ""), NUMBERING, ""))
    return F.get(F.filter(plain, lambda line: line.rlike(_VERDICT)), 0)


def parse_verdict_line(line) -> Column:
    """struct(verdict, fix) of a ``verdict_line``; '' / '' for NULL."""
    line = col(line)
    word = F.regexp_extract(line, _VERDICT, 1)
    verdict = None
    for known, label in K.VERDICT_WORDS:
        hit = word.rlike(rf"(?iu)\A{known}\z")
        verdict = F.when(hit, F.lit(label)) if verdict is None else verdict.when(hit, F.lit(label))
    return F.struct(
        F.coalesce(verdict, F.lit("")).alias("verdict"),
        F.when(line.isNotNull(), clean_fix(F.regexp_extract(line, _VERDICT, 2))).otherwise(F.lit("")).alias("fix"),
    )


def parse_reply(text) -> Column:
    """First line carrying a verdict -> struct(verdict, fix); '' / '' when none."""
    return parse_verdict_line(verdict_line(text))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row. Spark merges projections where a struct's fields are all that is
    read, which computes the struct anew for every use; it doesn't merge them across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def fallback_verdict(text) -> Column:
    """struct(found, verdict, fix) from the first stand-alone yes/no in the text."""
    t = col(text)
    rest = F.regexp_extract(t, _FALLBACK, 2)
    first_line = py_strip(F.get(F.split(rest, LINE_BREAK), 0))
    return F.struct(
        t.rlike(_FALLBACK).alias("found"),
        F.lower(F.regexp_extract(t, _FALLBACK, 1)).alias("verdict"),
        F.coalesce(first_line, F.lit("")).alias("fix"),
    )


def predict(df: DataFrame, reply: str = "reply", noun_phrase: str = "noun_phrase") -> DataFrame:
    """P7 + P8 + P9 + P10 + P11: add ``grammatical_pred``, ``correction`` and ``fix_pred``.

    Staged in separate projections so each parse runs once per row.
    """
    staged = df.withColumn("_text", reply_text(reply))
    staged = _once(staged, "_line", verdict_line("_text"))
    staged = staged.withColumn("_parsed", parse_verdict_line("_line")).withColumn("_fb", fallback_verdict("_text"))
    direct = F.col("_parsed.verdict").isin("yes", "no")
    yn = (
        F.when(direct, F.col("_parsed.verdict"))
        .when(F.col("_fb.found"), F.col("_fb.verdict"))
        .otherwise(F.lit("yes"))
    )
    fix_raw = (
        F.when(direct, F.col("_parsed.fix"))
        .when(F.col("_fb.found"), F.col("_fb.fix"))
        .otherwise(F.lit(""))
    )
    staged = staged.withColumn("_yn", yn).withColumn("_fix", clean_fix(fix_raw))
    staged = staged.withColumn(
        "_fix", F.when((F.col("_yn") == "no") & is_placeholder("_fix"), F.lit("")).otherwise(F.col("_fix"))
    )
    fix_norm = norm_np("_fix")
    demote = (F.col("_yn") == "no") & ((fix_norm == "") | (fix_norm == norm_np(noun_phrase)))
    staged = staged.withColumn("_yn", F.when(demote, F.lit("yes")).otherwise(F.col("_yn"))).withColumn(
        "_fix", F.when(demote, F.lit("")).otherwise(F.col("_fix"))
    )
    is_no = F.col("_yn") == "no"
    return staged.withColumn("grammatical_pred", F.col("_yn")).withColumn(
        "correction", F.when(is_no, F.col("_fix")).otherwise(F.coalesce(F.col(noun_phrase), F.lit("")))
    ).withColumn("fix_pred", F.when(is_no, F.col("_fix")).otherwise(F.lit(""))).drop(
        "_text", "_line", "_parsed", "_fb", "_yn", "_fix"
    )


def _word_tag_pieces(text) -> Column:
    pieces = F.split(col(text), " ")
    return F.filter(pieces, lambda x: x.rlike(r"(?s)\A[^/]+/.+"))


def parse_pos_reply(reply) -> Column:
    """P15: 'word/tag' pieces -> array<struct<word, tag>>; tag loses one leading '_' and is
    lower-cased. The array index is the running count of well-formed pieces."""
    text = F.regexp_replace(col(reply), "\n", " ")
    return F.transform(
        _word_tag_pieces(text),
        lambda x: F.struct(
            F.regexp_extract(x, r"(?s)\A([^/]+)/", 1).alias("word"),
            F.lower(F.regexp_replace(F.regexp_extract(x, r"(?s)\A[^/]+/(.+)", 1), r"\A_", "")).alias("tag"),
        ),
    )


def clean_iob_reply(reply) -> Column:
    """Newline -> space, boilerplate preface removed."""
    return F.regexp_replace(F.regexp_replace(col(reply), "\n", " "), K.IOB_PREFACE, "")


def parse_iob_reply(reply) -> Column:
    """The cleaned reply's 'word/tag' pieces."""
    text = clean_iob_reply(reply)
    return F.transform(
        _word_tag_pieces(text),
        lambda x: F.struct(
            F.regexp_extract(x, r"(?s)\A([^/]+)/", 1).alias("word"),
            F.regexp_extract(x, r"(?s)\A[^/]+/(.+)", 1).alias("tag"),
        ),
    )
