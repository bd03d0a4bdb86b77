"""Label maps and benchmark-table preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.text import clean_text, col, py_strip


def _lower_stripped(c) -> Column:
    return F.lower(py_strip(F.coalesce(col(c).cast("string"), F.lit(""))))


def label_strict(c) -> Column:
    """a/yes -> yes, b/no -> no, anything else lower-cased and passed through."""
    s = _lower_stripped(c)
    return F.when(s.isin(*K.STRICT_YES), "yes").when(s.isin(*K.STRICT_NO), "no").otherwise(s)


def label_wide(c) -> Column:
    """Adds y/true/1 and n/false/0; unknown or missing -> ''."""
    s = _lower_stripped(c)
    return F.when(s.isin(*K.WIDE_YES), "yes").when(s.isin(*K.WIDE_NO), "no").otherwise(F.lit(""))


def label_wide_pass(c) -> Column:
    """As P3 but unknown values pass through (lower-cased, stripped)."""
    s = _lower_stripped(c)
    return F.when(s.isin(*K.WIDE_YES), "yes").when(s.isin(*K.WIDE_NO), "no").otherwise(s)


def label_eval(c, case_sensitive: bool = False) -> Column:
    """P5: evaluation map; missing -> NULL. Case-sensitive mode maps only a/A/b/B."""
    s = py_strip(col(c).cast("string"))
    # One CASE over ``s``, so that it is computed once a row; NULL meets no branch and stays NULL.
    if case_sensitive:
        return F.when(s.isin("a", "A"), "yes").when(s.isin("b", "B"), "no").otherwise(s)
    s = F.lower(s)
    return (
        F.when(s == "a", "yes").when(s == "b", "no")
        .when(s.isin(*K.EVAL_EXTRA_YES), "yes").when(s.isin(*K.EVAL_EXTRA_NO), "no")
        .otherwise(s)
    )


def require_columns(df: DataFrame, columns) -> None:
    """S3: fail before any job runs when a required column is absent."""
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"Missing required column: {name}")


def format_benchmark(df: DataFrame, keep=()) -> DataFrame:
    """(sentence, noun_phrase[, gold_fix]) -> (sentence, noun_phrase, grammatical, corrected).

    A non-empty cleaned fix means the phrase is ungrammatical and the fix is the
    correction; otherwise the phrase is grammatical and corrects to itself.
    """
    require_columns(df, ("sentence", "noun_phrase"))
    fix = clean_text("gold_fix") if "gold_fix" in df.columns else F.lit("")
    staged = df.select(
        *keep,
        clean_text("sentence").alias("sentence"),
        clean_text("noun_phrase").alias("noun_phrase"),
        fix.alias("_fix"),
    )
    has_fix = F.length("_fix") > 0
    return staged.select(
        *keep,
        "sentence",
        "noun_phrase",
        label_strict(F.when(has_fix, "no").otherwise("yes")).alias("grammatical"),
        F.when(has_fix, F.col("_fix")).otherwise(F.col("noun_phrase")).alias("corrected"),
    )
