"""File sources: quoted CSV (S2), encoding fallback (S1), column checks (S3),
sentence-per-line text (S4), raw prediction lines (S5), recursive directory scans
(S6) and per-file column detection (S7).

CSV goes through ``sources.csv_splits``: charset and header are decided for each file on the executors,
one file is read by many tasks, and nothing is copied. Paths are compared without percent-encoding.
"""

from __future__ import annotations

import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detlens import constants as K
from detlens.functions.lines import is_data_line
from detlens.functions.text import WS
from detlens.session import materialize
from detlens.sources.csv_splits import BROADCAST_BYTES, CsvFiles, one_scheme, plain_path

#: For Spark's own reader: folders of small files that Spark wrote, with partition columns.
CSV_READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}


def missing_to_null(df: DataFrame) -> DataFrame:
    """Strings that the reference's CSV reader takes as missing become NULL."""
    return df.select(*[F.when(F.col(f"`{c}`").isin(*K.PANDAS_NA_STRINGS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                       if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_csv(spark: SparkSession, paths, columns: list[str] | None = None, missing: bool = True) -> DataFrame:
    """Header, RFC-4180 quotes and embedded newlines; every column a string, missing-value strings NULL
    (``missing=False`` keeps them). UTF-8; a file may be read by many tasks. ``columns`` spares the look for them.
    A file that can't be parsed is an error."""
    root = paths if isinstance(paths, list) else [paths]
    files = file_list(spark, root)
    return _one_table(CsvFiles(spark, root, files), columns, missing)


def _one_table(csv: CsvFiles, columns: list[str] | None, missing: bool) -> DataFrame:
    """The rows of all files, each file's fields under its own names. A file in error fails the read; one without a
    header has no rows."""
    faulty = csv.files.filter(F.col("error").isNotNull() & (F.col("error") != K.ERROR_EMPTY_FILE)).orderBy("path").first()
    if faulty:
        raise ValueError(f"{faulty['path']}: {faulty['error']}")
    names = csv.column_names() if columns is None else columns
    if not names:
        return csv.spark.createDataFrame([], T.StructType([]))
    rows = csv.rows(F.array(*[F.lit(n) for n in names]))
    refused = F.raise_error(F.concat(F.col("path"), F.lit(f": {K.ERROR_TOO_MANY_FIELDS}"))).cast("array<string>")
    rows = rows.select(F.when(F.col("extra") > 0, refused).otherwise(F.col("fields")).alias("fields"))
    out = rows.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return missing_to_null(out) if missing else out


def file_list(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(path) of every file under ``paths``, empty ones included, from the listing that Spark makes for any read.
    Contents are not read, and names pass the driver only if some files are empty."""
    root = paths if isinstance(paths, list) else [paths]
    options = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": glob} if glob else {})
    try:
        filled = spark.read.format("binaryFile").options(**options).load(root).select(one_scheme(F.col("path")).alias("path"))
        n_filled = filled.count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise
        filled, n_filled = spark.createDataFrame([], "path string"), 0
    # Spark's readers pass over files of length 0, but their listing has them.
    listed = spark.read.options(**options).text(root)._jdf.inputFiles()
    if len(listed) == n_filled:
        return filled
    # One call, not one for each file.
    every = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", listed)
    names = spark.createDataFrame([(every,)], "names string").select(F.explode(F.split("names", "\n")).alias("path")).filter("path <> ''")
    return filled.unionByName(names.select(plain_path("path").alias("path")).join(filled, "path", "left_anti"))


def file_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Raw lines with their file path, recursively under ``root``."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(root).select("value", plain_path("_metadata.file_path").alias("path"))


#: The charsets that are tried in this order.
CHARSETS = ("utf-8", "cp1252", "latin1")


def detect_encodings(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, encoding) per file: utf-8 when every line is valid UTF-8, otherwise
    cp1252, or latin1 when a byte that cp1252 leaves undefined occurs anywhere in the file."""
    found = CsvFiles(spark, root, file_list(spark, root, glob), glob, CHARSETS).files
    return found.select("path", F.coalesce("charset", F.lit(CHARSETS[0])).alias("encoding"))


def read_csv_any_encoding(spark: SparkSession, root: str, glob: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every CSV under ``root`` with the charset chosen for it and under the names of its own header, so that
    files with other columns or another order of them keep theirs. No files: no columns, no rows."""
    return _one_table(CsvFiles(spark, root, file_list(spark, root, glob), glob, CHARSETS), columns, missing=True)


def tokenize_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Right-strip each line and split on single spaces (empty tokens survive)."""
    stripped = F.regexp_replace(F.col(value), rf"{WS}+\z", "")
    return lines.select("*", F.posexplode(F.split(stripped, " ", -1)).alias("pos", "w")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def logical_file(path_col: str | Column = "path") -> Column:
    """A Spark table partition is a directory of part files; that directory is the
    'file' results are reported for. Other files stand for themselves."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    # No regex: one that ends in ``\z`` is tried from every character of a path, here for every row.
    name = F.substring_index(p, "/", -1)
    return F.when(name.startswith("part-"), F.left(p, F.length(p) - F.length(name) - 1)).otherwise(p)


def scan_prediction_dir(spark: SparkSession, root: str, pattern: str = K.DEFAULT_PREDICTIONS_GLOB) -> DataFrame:
    """S5 + S6: raw data lines of every file under ``root`` whose path has a component
    matching ``pattern``; blank and header lines dropped. (file, value)."""
    lines = data_lines(spark, root).withColumn("file", logical_file(plain_path("path")))
    return lines.filter(F.col("file").rlike(_component(pattern))).select("file", "value")


def data_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, value) of every data line under ``root``, with the path as Spark gives it."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    return lines.filter(is_data_line("value")).select(F.col("_metadata.file_path").alias("path"), "value")


def prediction_counts(by_path: DataFrame, columns=("tp", "fp", "fn", "tn", "n_total"), pattern: str = K.DEFAULT_PREDICTIONS_GLOB) -> DataFrame:
    """Counts for each path of ``data_lines``, added up for each file that ``scan_prediction_dir`` looks at. Names are
    worked out and compared once for each path, not for each line."""
    named = by_path.withColumn("file", logical_file(plain_path("path"))).filter(F.col("file").rlike(_component(pattern)))
    return named.groupBy("file").agg(*[F.sum(c).alias(c) for c in columns])


def _component(glob: str) -> str:
    rx = fnmatch.translate(glob)
    rx = rx[rx.index(":") + 1:rx.rindex(")")] if rx.startswith("(?s:") else rx
    return rf"(?s)(?:\A|/){rx}(?:/|\z)"


def prediction_files(spark: SparkSession, root: str, pattern: str = K.DEFAULT_PREDICTIONS_GLOB) -> DataFrame:
    """(file) for every file that ``scan_prediction_dir`` looks at, with or without data lines."""
    files = file_list(spark, root).select(logical_file("path").alias("file"))
    return files.filter(F.col("file").rlike(_component(pattern))).distinct()


def every_file(files: DataFrame, counts: DataFrame, columns=("tp", "fp", "fn", "tn", "n_total")) -> DataFrame:
    """The counts of each file, zero where it has none, in the order of the paths."""
    out = files.join(counts, "file", "left")
    return out.select("file", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in columns]).orderBy("file")


def find_label_columns(header: Column, truth: str | None = None, pred: str | None = None) -> dict[str, Column]:
    """The truth and prediction columns that a header line has, and an error if it lacks one."""
    names = F.transform(F.split(F.regexp_replace(header, "^\ufeff", ""), ","), lambda c: F.trim(F.trim(c), F.lit('"')))
    found = label_columns(names, truth, pred)
    empty = F.coalesce(F.trim(header), F.lit("")) == ""
    return found | {"error": F.when(empty, F.lit(K.ERROR_EMPTY_FILE)).otherwise(found["error"])}


def label_columns(names: Column, truth: str | None = None, pred: str | None = None) -> dict[str, Column]:
    """The truth and prediction columns among ``names``, and an error if one is lacking.

    A role's candidates are the caller's name and the usual ones, in this order; the first that the
    header has is taken."""

    def pick(given: str | None, usual) -> Column:
        wanted = F.array(*[F.lit(c) for c in ([given] if given else []) + list(usual)])
        return F.get(F.filter(wanted, lambda c: F.array_contains(names, c)), 0)

    t, p = pick(truth, K.TRUTH_COLUMNS), pick(pred, K.PREDICTION_COLUMNS)
    error = F.when(t.isNull(), F.lit(K.ERROR_NO_TRUTH)).when(p.isNull(), F.lit(K.ERROR_NO_PREDICTION))
    return {"truth_column": t, "pred_column": p, "error": error}


def read_label_columns(spark: SparkSession, root: str, truth: str | None = None, pred: str | None = None, glob: str | None = None):
    """Every CSV under ``root``: (files, rows) with files (path, error) complete, in rows
    (path, truth, pred) those of the files without an error.

    A file that isn't UTF-8, ends within quotes, lacks a column or has a record with more fields than
    its header is a row with an error, and none of its rows count; the others are read."""
    csv = CsvFiles(spark, root, file_list(spark, root, glob), glob)
    roles = label_columns(F.col("columns"), truth, pred)
    csv.files = csv.files.withColumn("error", F.coalesce("error", roles["error"]))
    rows = csv.rows(F.array(roles["truth_column"], roles["pred_column"]))
    rows = materialize(rows.select("path", F.get("fields", F.lit(0)).alias("truth"), F.get("fields", F.lit(1)).alias("pred"), "extra"), "label-rows")
    long = materialize(rows.filter("extra > 0").select("path").distinct(), "long-files")
    files = csv.files.join(long.withColumn("_error", F.lit(K.ERROR_TOO_MANY_FIELDS)), "path", "left").select(
        "path", F.coalesce("error", "_error").alias("error"))
    size = long.agg(F.sum(F.length("path") + 16)).first()[0]
    # Rows are not shuffled by their path for the few files that are left out, if any.
    whole = rows if size is None else rows.join(F.broadcast(long) if size <= BROADCAST_BYTES else long, "path", "left_anti")
    return files, missing_to_null(whole.select("path", "truth", "pred"))
