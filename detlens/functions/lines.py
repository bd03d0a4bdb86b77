"""Raw prediction-line classifier (P17) and CSV line rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.functions.text import col, pattern


def line_pattern(gold: str, pred: str, case_sensitive: bool = False) -> str:
    """The raw-line pattern for (gold label field, any field, predicted label field)."""
    flags = "" if case_sensitive else "(?iu)"
    return flags + pattern(K.PAT_LINE_CLASS, gold=gold, pred=pred)


def classify_line(line, case_sensitive: bool = False) -> Column:
    """P17: 'tp' / 'fn' / 'fp' / 'tn' by the first matching pattern, else NULL."""
    line = col(line)
    out = None
    for cls, gold, pred in K.LINE_CLASSES:
        hit = line.rlike(line_pattern(gold, pred, case_sensitive))
        out = F.when(hit, F.lit(cls)) if out is None else out.when(hit, F.lit(cls))
    return out


def is_data_line(line) -> Column:
    """Skip blank lines and header lines (``sentence,`` in any case)."""
    line = col(line)
    return (line != "") & ~F.lower(line).startswith(K.HEADER_PREFIX)


CSV_LINE_OPTIONS = {
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_line(*columns) -> Column:
    """The line Spark's CSV writer emits for these fields (minimal quoting)."""
    return F.to_csv(F.struct(*[col(c) for c in columns]), CSV_LINE_OPTIONS)
