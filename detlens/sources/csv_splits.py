"""CSV files of any size, number, charset and header, read as raw lines in Spark's own splits.

A line may begin inside a quoted field, and whether it does depends on all lines before it. So a file
is read in two passes, neither of which copies it or brings anything but its splits' facts together:

1. ``scan_splits`` follows the quotes of each split twice, as if it began outside and inside a quoted
   field, and keeps where either way ends: one row for each split, with what its bytes say about the
   charset and, for the first split, the header record. ``start_states`` chains these two-valued maps
   over a file's splits (a map is constant, keeps the state or swaps it, so the state is the last
   constant plus the swaps since), which tells how each split really begins.
2. ``split_rows`` parses each split from its state. Records that cross a split's end are put together
   from their pieces (``crossing_rows``), of which a split has two at most.

A file that cannot be parsed is an error of that file alone. Files are found by Spark, so any
file system and compression that it reads will do; a compressed file is one split.

Fixed rules, as the reference's reader has them: the first record that is not blank is the header;
blank lines are skipped; a quote opens a field only as its first character; two quotes within one
stand for one; what follows a closing quote belongs to the field; fewer fields than the header's
leave the rest missing; more make the file an error, and so does an open quote at the end.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.session import materialize

# Workers get this module's functions by value, so that they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The facts on all splits are broadcast only if they are smaller; else lines are dealt by split.
BROADCAST_BYTES = 4 << 20
# Bytes cp1252 leaves undefined; a file holding one is read as latin1.
CP1252_UNDEFINED_HEX = ("81", "8D", "8F", "90", "9D")

_FIELD = re.compile(rb'"(?:[^"]|"")*+"[^,]*+(?:,|\Z)|(?!")[^,]*+(?:,|\Z)', re.S)
_CLOSING = re.compile(rb'(?:[^"]|"")*+"[^,]*+(?:,|\Z)', re.S)
_FIELD_TEXT = re.compile(_FIELD.pattern.decode(), re.S)
_QUOTED_TEXT = re.compile('"(?:[^"]|"")*+"', re.S)
_SPLIT_SCHEMA = ("path string, start long, open0 boolean, open1 boolean, closes1 boolean, invalid boolean, undefined boolean, head binary")


def plain_path(path: str | Column) -> Column:
    """A file's path without percent-encoding: the one form in which paths are compared and reported."""
    path = F.col(path) if isinstance(path, str) else path
    return one_scheme(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def one_scheme(path: Column) -> Column:
    """Spark writes a local file's path with one slash or with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def raw_lines(spark: SparkSession, paths, glob: str | None = None, undefined: bool = False) -> DataFrame:
    """(path, start, nth, value, invalid, undefined): the bytes of every line; ``start`` is where its split
    begins, ``nth`` rises within a split. Bytes that cp1252 leaves undefined are looked for if asked."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = F.hex("value").rlike("^(?:..)*?(?:" + "|".join(CP1252_UNDEFINED_HEX) + ")") if undefined else F.lit(False)
    return reader.text(paths).select(
        plain_path("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("value"),
        (~F.is_valid_utf8("value")).alias("invalid"), found.alias("undefined"))


def open_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open after a line that begins outside or inside one."""
    at, pattern = 0, _CLOSING if inside else _FIELD
    while True:
        m = pattern.match(line, at)
        if m is None:
            return True
        if m.end() == len(line) and (m.end() == at or line[-1:] != b","):
            return False
        at, pattern = m.end(), _FIELD


def _by_split(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """((path, start), columns of some of its lines): a split's lines follow each other, in several parts."""
    for batch in batches:
        path, start = batch.column("path"), batch.column("start")
        if not batch.num_rows:
            continue
        change = [0]
        if batch.num_rows > 1:
            differs = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
            change += [i + 1 for i in pc.indices_nonzero(differs).to_pylist()]
        for a, b in zip(change, [*change[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            yield (path[a].as_py(), start[a].as_py()), {n: part.column(n) for n in names}


class _SplitScan:
    """What one split is seen to be, line by line."""

    def __init__(self, key: tuple):
        self.key, self.open, self.closes1, self.invalid, self.undefined = key, [False, True], False, False, False
        self.head = [] if key[1] == 0 else None
        self.header: bytes | None = None

    def add(self, value: pa.Array, invalid: pa.Array, undefined: pa.Array) -> None:
        self.invalid |= bool(pc.any(invalid).as_py())
        self.undefined |= bool(pc.any(undefined).as_py())
        if self.head is not None:
            self._seek_header(value)
        for i in pc.indices_nonzero(pc.match_substring(value, '"')).to_pylist():
            line = value[i].as_py()
            same = self.open[0] == self.open[1]
            self.open[0] = open_after(line, self.open[0])
            self.open[1] = self.open[0] if same else open_after(line, self.open[1])
            self.closes1 |= not self.open[1]

    def _seek_header(self, value: pa.Array) -> None:
        for x in value:
            line = x.as_py()
            if not self.head and not line.strip(b" \t\r"):
                continue
            self.head.append(line)
            if not open_after(line, len(self.head) > 1):
                self.header, self.head = b"\n".join(self.head), None
                return

    def row(self) -> dict:
        return {"path": self.key[0], "start": self.key[1], "open0": self.open[0], "open1": self.open[1], "closes1": self.closes1,
                "invalid": self.invalid, "undefined": self.undefined, "head": self.header}


def scan_splits(lines: DataFrame) -> DataFrame:
    """(path, start, open0, open1, closes1, invalid, undefined, head), a row for each split of ``raw_lines``: whether a
    quoted field is open at its end if it began outside (0) or inside (1) one, and whether the latter ever ends."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), *((n, pa.bool_()) for n in ("open0", "open1", "closes1", "invalid", "undefined")),
                        ("head", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for key, part in _by_split(batches, ["value", "invalid", "undefined"]):
            if scan is None or scan.key != key:
                if scan is not None:
                    yield pa.RecordBatch.from_pylist([scan.row()], schema)
                scan = _SplitScan(key)
            scan.add(part["value"], part["invalid"], part["undefined"])
        if scan is not None:
            yield pa.RecordBatch.from_pylist([scan.row()], schema)

    return lines.select("path", "start", "value", "invalid", "undefined").mapInArrow(run, _SPLIT_SCHEMA)


def start_states(splits: DataFrame) -> DataFrame:
    """Add ``inside`` (the split begins in a quoted field), ``opener`` (the split where the record that it begins in
    began), ``crosses`` (a record that began here goes on in the next one) and ``ends_open``."""
    number = lambda c: F.col(c).cast("int")
    file = Window.partitionBy("path").orderBy("start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("open0") & ~F.col("open1"), 1)).over(before), F.lit(0))
    known = splits.withColumn("_swaps", swaps)
    constant = F.when(F.col("open0") == F.col("open1"), number("open0") - F.col("_swaps"))
    since = F.coalesce(F.last(constant, ignorenulls=True).over(before), F.lit(0)) + F.col("_swaps")
    states = known.withColumn("inside", F.pmod(since, F.lit(2)) == 1).drop("_swaps")
    states = states.withColumn("ends_open", F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0")))
    states = states.withColumn("crosses", F.col("ends_open") & (~F.col("inside") | F.col("closes1")))
    return states.withColumn("opener", F.last(F.when(F.col("crosses"), F.col("start")), ignorenulls=True).over(before))


def _fields(record: str) -> list[str]:
    """The fields of one record, for those that the csv module refuses: a lone carriage return is part of a field."""
    out, at, record = [], 0, record.removesuffix("\r")
    while True:
        m = _FIELD_TEXT.match(record, at)
        field = m[0].removesuffix(",") if m[0].endswith(",") else m[0]
        if field.startswith('"'):
            inner = _QUOTED_TEXT.match(field)
            field = inner[0][1:-1].replace('""', '"') + field[inner.end():]
        out.append(field)
        if m.end() == len(record) and (m.end() == at or record[-1:] != ","):
            return out
        at = m.end()


def _parse(lines: list[bytes], charset: str) -> list[list[str]]:
    """The records of whole lines, blank ones left out."""
    csv.field_size_limit(sys.maxsize)
    try:
        records = csv.reader([x + "\n" for x in b"\n".join(lines).decode(charset, "replace").split("\n")])
        return [r for r in records if r and (len(r) > 1 or r[0] == "" or r[0].strip(" \t"))]
    except csv.Error:
        out, held, inside = [], [], False
        for line in lines:
            held.append(line)
            inside = open_after(line, inside)
            if not inside:
                if b"\n".join(held).strip(b" \t\r"):
                    out.append(_fields(b"\n".join(held).decode(charset, "replace")))
                held = []
        return out


def _columns_of(head: bytes, charset: str) -> list[str]:
    """The header's column names; a name that recurs is numbered."""
    names, seen = [], {}
    for name in _parse([head], charset)[0]:
        name = name.removeprefix("\ufeff") if not names else name
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def file_facts(states: DataFrame, files: DataFrame, charsets: tuple[str, ...]) -> DataFrame:
    """(path, charset, columns, error) for every file of ``files`` (path): the first of ``charsets`` that can hold its bytes,
    its header's columns, and why it cannot be read, if so."""
    facts = states.groupBy("path").agg(
        F.max("invalid").alias("invalid"), F.max("undefined").alias("undefined"), F.max("head").alias("head"),
        F.max_by("ends_open", "start").alias("ends_open"))
    fits = {"utf-8": ~F.col("invalid"), "cp1252": ~F.col("undefined"), "latin1": F.lit(True)}
    charset = F.coalesce(*[F.when(fits[c], F.lit(c)) for c in charsets])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_columns_of(h, c or "utf-8") if h is not None else None for h, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.list_(pa.string())), batch.column(3)],
                                             names=["path", "charset", "columns", "ends_open"])

    known = facts.select("path", "head", charset.alias("charset"), "ends_open").mapInArrow(
        parsed, "path string, charset string, columns array<string>, ends_open boolean")
    error = (F.when(F.col("ends_open"), F.lit(K.ERROR_OPEN_QUOTE)).when(F.col("columns").isNull(), F.lit(K.ERROR_EMPTY_FILE))
             .when(F.col("charset").isNull(), F.lit(K.ERROR_CHARSET)))
    return files.join(known, "path", "left").select("path", "charset", "columns", error.alias("error"))


_ROWS = "path string, fields array<string>, extra int"


def _taken(rows: list[list[str]], path: str, take: list[int], width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows), pa.string()),
         pa.array([[r[i] if 0 <= i < len(r) else None for i in take] for r in rows], pa.list_(pa.string())),
         pa.array([max(0, len(r) - width) for r in rows], pa.int32())], names=["path", "fields", "extra"])


def _boundaries(value: pa.Array, lines: list[bytes], inside: bool) -> tuple[list[int], bool]:
    """(the lines after which no quoted field is open, whether one is open at the end)."""
    ends = []
    for i, quoted in enumerate(pc.match_substring(value, '"').to_pylist()):
        if quoted:
            inside = open_after(lines[i], inside)
        if not inside:
            ends.append(i)
    return ends, inside


def split_rows(lines: DataFrame) -> DataFrame:
    """(path, fields, extra) of the records that begin and end in one split. ``lines`` come with ``inside`` of their split
    and ``charset``, ``width`` and ``take`` (the places of the wanted fields) of their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, inside, leading, header = None, [], False, False, False
        for key, part in _by_split(batches, ["value", "inside", "charset", "width", "take"]):
            if key != last:  # what is held of the split before crosses its end
                last, held, header = key, [], key[1] == 0
                inside = leading = part["inside"][0].as_py()
            block = part["value"].to_pylist()
            ends, inside = _boundaries(part["value"], block, inside)
            if not ends:
                held += [] if leading else block
                continue
            whole = block[ends[0] + 1: ends[-1] + 1] if leading else held + block[: ends[-1] + 1]
            leading, held = False, block[ends[-1] + 1:]
            rows = _parse(whole, part["charset"][0].as_py())
            if header and rows:
                rows, header = rows[1:], False
            if rows:
                yield _taken(rows, key[0], part["take"][0].as_py(), part["width"][0].as_py())

    return lines.select("path", "start", "value", "inside", "charset", "width", "take").mapInArrow(run, _ROWS)


def crossing_rows(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, fields, extra) of the records that cross the end of a split, from the lines of the splits that hold pieces."""
    schema = pa.schema([("path", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opener, head, tail, inside, leading = None, None, [], [], False, False

        def found():
            rows = [{"path": last[0], "record": record, "start": last[1], "piece": b"\n".join(x)}
                    for record, x in ((opener, head), (last[1], tail)) if x]
            return pa.RecordBatch.from_pylist(rows, schema)

        for key, part in _by_split(batches, ["value", "inside", "opener"]):
            if key != last:
                if last is not None:
                    yield found()
                last, opener, head, tail = key, part["opener"][0].as_py(), [], []
                inside = leading = part["inside"][0].as_py()
            block = part["value"].to_pylist()
            ends, inside = _boundaries(part["value"], block, inside)
            if leading:
                head += block[: ends[0] + 1] if ends else block
                leading = not ends
            tail = (block[ends[-1] + 1:] if ends else [] if leading else tail + block)
        if last is not None:
            yield found()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, parts, charset, width, take in zip(*(batch.column(c).to_pylist() for c in ("path", "parts", "charset", "width", "take"))):
                rows = _parse(b"\n".join(p["piece"] for p in parts).split(b"\n"), charset)
                if rows:
                    yield _taken(rows, path, take, width)

    found = lines.select("path", "start", "value", "inside", "opener").mapInArrow(pieces, "path string, record long, start long, piece binary")
    records = found.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    files = facts.select("path", "charset", "width", "take").distinct()
    return records.join(files, "path").select("path", "parts", "charset", "width", "take").mapInArrow(parsed, _ROWS)


class CsvFiles:
    """The CSV files under a path. ``files`` is (path, charset, columns, error), a row for each."""

    def __init__(self, spark: SparkSession, paths, files: DataFrame, glob: str | None = None, charsets: tuple[str, ...] = ("utf-8",)):
        self.spark = spark
        self._lines = lambda: raw_lines(spark, paths, glob, undefined="cp1252" in charsets)
        try:
            self.states = materialize(start_states(scan_splits(self._lines())), "csv-splits")
        except AnalysisException as e:  # no file has a byte
            if "PATH_NOT_FOUND" in str(e):
                raise
            self.states = spark.createDataFrame([], _SPLIT_SCHEMA + ", inside boolean, ends_open boolean, crosses boolean, opener long")
        self.files = materialize(file_facts(self.states, files, charsets), "csv-files")

    def column_names(self) -> list[str]:
        """The distinct names of all readable files' columns, in the order in which the files have them most to the left."""
        names = self.files.filter("error IS NULL").select(F.posexplode("columns").alias("at", "name"))
        return [r["name"] for r in names.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]

    def rows(self, wanted: Column) -> DataFrame:
        """(path, fields, extra) of every record of the files without an error: the fields of the columns that the array
        ``wanted`` (over a file's ``columns``) names, NULL where a file has no such column or the record ends before it,
        and by how many fields the record exceeds the header."""
        take = F.transform(wanted, lambda c: (F.coalesce(F.array_position("columns", c), F.lit(0)) - 1).cast("int"))
        usable = self.files.filter("error IS NULL").select("path", "charset", F.size("columns").alias("width"), take.alias("take"))
        facts = materialize(self.states.select("path", "start", "inside", "opener", "crosses").join(usable, "path"), "csv-split-facts")
        size = facts.agg(F.sum(F.length("path") + 8 * F.size("take") + 64).alias("bytes"),
                         F.count_if(F.col("inside") | F.col("crosses")).alias("crossed")).first()
        out = split_rows(self._with_facts(facts, size["bytes"] or 0))
        if size["crossed"]:
            out = out.unionByName(crossing_rows(self._with_facts(facts.filter("inside OR crosses"), size["bytes"]), facts))
        return out

    def _with_facts(self, facts: DataFrame, size: int) -> DataFrame:
        lines = self._lines().drop("invalid", "undefined")
        if size <= BROADCAST_BYTES:  # lines stay in the order of their split
            return lines.join(F.broadcast(facts), ["path", "start"])
        return lines.join(facts, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "nth")
