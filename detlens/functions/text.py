"""Scalar text functions as Spark Columns.

All of these are deterministic JVM expressions except NFKC, for which Spark has no builtin: an Arrow
UDF that sees values with a non-ASCII character only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from detlens import constants as K

# Character classes written for Java regex so that they equal Python's Unicode classes.
# WS   = str.isspace()  (Python's \s and the set str.strip() removes)
# LINE_BREAK = the separators str.splitlines() splits on
WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{WS_CHARS}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
DIGIT = r"\p{Nd}"
WORD_CHAR = r"[\p{L}\p{N}_]"


def pattern(template: str, **extra) -> str:
    """Fill a fixed pattern's placeholders with the Python-equivalent Java classes."""
    return template.format(s=WS, d=DIGIT, w=WORD_CHAR, ws=WS_CHARS, **extra)


NUMBERING = pattern(K.PAT_NUMBERING)
#: Whitespace that is not one plain space: all that collapsing has to change.
LOOSE_WS = f"{WS}{{2,}}|[{WS_CHARS}&&[^ ]]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same whitespace set as literal characters, for ``trim`` (no regex needed).
WS_LITERAL = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(cp) for cp in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(col(c), F.lit(WS_LITERAL))


def strip_chars(c, chars: str) -> Column:
    """``str.strip(chars)``."""
    return F.trim(col(c), F.lit(chars))


def collapse_ws(c) -> Column:
    return F.regexp_replace(col(c), LOOSE_WS, " ")


def is_non_ascii(c) -> Column:
    return col(c).rlike(r"[^\x00-\x7F]")


def nfkc(c) -> Column:
    """Unicode NFKC. Spark has no builtin for it: non-ASCII values go through an Arrow UDF, ASCII
    values, which NFKC leaves alone, reach it as NULL."""

    def normalize(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    c = col(c)
    other = c.isNotNull() & is_non_ascii(c)
    # Defined here, so that workers get the function itself and need not find the package.
    udf = F.pandas_udf(normalize, "string")
    return F.when(other, udf(F.when(other, c))).otherwise(c)


def clean_text(c) -> Column:
    """NFKC, NBSP -> space, strip, collapse whitespace, missing tokens -> ''."""
    t = py_strip(F.translate(nfkc(F.coalesce(col(c), F.lit(""))), "\u00A0", " "))
    # No missing token holds whitespace, so they are looked for before the dearer step, which then runs once.
    return F.when(F.lower(t).isin(*K.MISSING_TOKENS), F.lit("")).otherwise(collapse_ws(t))


def clean_fix(c) -> Column:
    """Clean the text after a verdict (numbering, boilerplate, punctuation, quotes)."""
    s = py_strip(F.coalesce(col(c), F.lit("")))
    s = F.regexp_replace(s, NUMBERING, "")
    s = F.regexp_replace(s, pattern(K.PAT_BOILERPLATE), "")
    s = F.regexp_replace(s, pattern(K.PAT_LEADING_PUNCT), "")
    s = strip_chars(py_strip(s), K.QUOTE_CHARS)
    return py_strip(s)


def is_placeholder(c) -> Column:
    """P10: missing, blank, a literal placeholder, or wrapped in angle brackets."""
    c = col(c)
    t = F.lower(py_strip(c))
    return (
        c.isNull()
        | (t == "")
        | t.isin(*K.PLACEHOLDERS)
        | t.startswith("<")
        | t.endswith(">")
    )


def norm_np(c) -> Column:
    """Noun-phrase normal form used for the no-op check."""
    t = F.lower(py_strip(F.coalesce(col(c), F.lit(""))))
    t = py_strip(strip_chars(t, K.QUOTE_CHARS))
    t = F.regexp_replace(t, K.PAT_TRAILING_NP_PUNCT, "")
    return collapse_ws(t)


def safe_name(c) -> Column:
    """Runs of characters outside [A-Za-z0-9._-] become '_'."""
    return F.regexp_replace(col(c), K.PAT_UNSAFE_NAME, "_")


def basename(c) -> Column:
    """Last path component (trailing slashes ignored)."""
    return F.regexp_extract(col(c), r"([^/]*)/*\z", 1)


def artifact_key(model, input_path) -> Column:
    """``<safe model>__<input basename>__predictions.csv``."""
    m = col(model)
    m = F.when(m.isNull() | (m == ""), F.lit("model")).otherwise(m)
    return F.concat(safe_name(m), F.lit("__"), basename(input_path), F.lit(K.PREDICTIONS_SUFFIX))


def edit_distance(a, b) -> Column:
    """Character Levenshtein distance of the stripped strings (NULL counts as '')."""
    return F.levenshtein(
        py_strip(F.coalesce(col(a), F.lit(""))), py_strip(F.coalesce(col(b), F.lit("")))
    ).cast("bigint")
