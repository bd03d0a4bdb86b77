import csv
import io
import random

import pytest

from detlens import constants as K
from detlens.sources import csv_splits as S
from detlens.sources import files as SRC


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that records cross them."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def quoted_rows(n, seed, longest=400):
    rng = random.Random(seed)
    field = lambda: rng.choice((
        "", "x", "two words", 'say "hi"', "a,b", "line\nbreak", "\n\n", '"', '""', "é ü", " lead ", "\r\n", 'q"\n,"q', "z" * rng.randrange(longest),
        "\n".join("long text, more" for _ in range(rng.randrange(60)))))
    return [(str(i), field(), field()) for i in range(n)]


def write(path, rows, header=("id", "a", "b"), encoding="utf-8", **options):
    buffer = io.StringIO()
    writer = csv.writer(buffer, **{"lineterminator": "\n"} | options)
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(buffer.getvalue().encode(encoding))


@pytest.mark.parametrize("options", [{}, {"quoting": csv.QUOTE_ALL}, {"lineterminator": "\r\n"}])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, options):
    rows = quoted_rows(300, 1)
    write(tmp_path / "a.csv", rows, **options)
    got = SRC.read_csv(spark, str(tmp_path), missing=False)
    assert S.raw_lines(spark, str(tmp_path)).select("start").distinct().count() > 50
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_equals_spark_reading_a_file_in_one_task(spark, tmp_path, small_splits):
    rows = [(i, a.replace("\r", ""), b.replace("\r", "")) for i, a, b in quoted_rows(200, 2)]
    write(tmp_path / "a.csv", rows, quoting=csv.QUOTE_ALL)
    whole = SRC.missing_to_null(spark.read.options(**SRC.CSV_READ_OPTIONS).csv(str(tmp_path)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, SRC.read_csv(spark, str(tmp_path)).collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)


def test_a_field_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i} says "{i}"' for i in range(400))
    rows = [("1", "x", "y"), ("2", long, long), ("3", long, ""), ("4", "", "end\n")]
    write(tmp_path / "a.csv", rows)
    assert sorted(map(tuple, SRC.read_csv(spark, str(tmp_path), missing=False).collect())) == rows


def test_dealing_lines_by_split_gives_the_same(spark, tmp_path, small_splits, monkeypatch):
    rows = quoted_rows(150, 3)
    for i in range(3):
        write(tmp_path / f"{i}.csv", rows[i * 50: i * 50 + 50])
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, SRC.read_csv(spark, str(tmp_path), missing=False).collect())) == sorted(rows)


def test_open_after_agrees_with_the_csv_module():
    rng = random.Random(5)
    for _ in range(4000):
        line = "".join(rng.choice('ab,"" \r') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            # With a line of its own after it, an open field swallows the line.
            rows = list(csv.reader([('"' if inside else "") + line.replace("\r", "r") + "\n", "after\n"]))
            assert S.open_after(line.replace("\r", "r").encode(), inside) == (not (rows and rows[-1] == ["after"])), (line, inside)


def test_start_states_follow_the_maps(spark):
    rng = random.Random(6)
    rows, expected = [], []
    for f in range(20):
        state, opener = False, None
        for i in range(rng.randrange(1, 12)):
            open0, open1 = rng.choice((True, False)), rng.choice((True, False))
            closes1 = not open1 or rng.choice((True, False))
            expected.append((f"f{f}", i, state, opener if state else None))
            rows.append((f"f{f}", i, open0, open1, closes1, False, False, None))
            ends = open1 if state else open0
            opener = i if ends and (not state or closes1) else opener
            state = ends
    df = S.start_states(spark.createDataFrame(rows, S._SPLIT_SCHEMA).repartition(4))
    got = [(r.path, r.start, r.inside, r.opener if r.inside else None) for r in df.collect()]
    assert sorted(got) == sorted(expected)


def test_files_with_a_charset_a_header_and_a_path_of_their_own(spark, tmp_path, small_splits):
    odd = tmp_path / "my runs 100%+"
    odd.mkdir()
    write(odd / "a b.csv", [("1", "café", "œ")], encoding="cp1252")
    write(odd / "c%20d.csv", [("\x81é", "2")], header=("a", "id"), encoding="latin1")
    write(odd / "e+f.csv", [("3", "日本", "x")], header=("id", "b", "c"))
    (odd / "g.csv").write_bytes("﻿id,a\n4,ß\n".encode())
    (odd / "h.csv").write_bytes(b"")
    (odd / "i.csv").write_bytes(b"\n \n")
    (odd / "j.csv").write_bytes(b'\n"id","a"\r\n5,x\ry\r\n6,"u\ry"\r\n\r\n')
    chosen = {r.path.rsplit("/", 1)[1]: r.encoding for r in SRC.detect_encodings(spark, str(odd)).collect()}
    assert chosen == {"a b.csv": "cp1252", "c%20d.csv": "latin1", "e+f.csv": "utf-8", "g.csv": "utf-8", "h.csv": "utf-8", "i.csv": "utf-8", "j.csv": "utf-8"}
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in SRC.read_csv_any_encoding(spark, str(odd)).collect()}
    assert got == {"1": ("café", "œ", None), "2": ("\x81é", None, None), "3": (None, "日本", "x"), "4": ("ß", None, None),
                   "5": ("x\ry", None, None), "6": ("u\ry", None, None)}


def test_errors_stay_in_their_file(spark, tmp_path, small_splits):
    head = "grammatical,grammatical_pred\n"
    files = {"good one.csv": head + "yes,yes\nno\n\n" + "no,no\n" * 90, "open%20quote.csv": head + "yes,yes\n" * 60 + 'no,"no\n' + "yes,yes\n" * 60,
             "long.csv": head + "yes,yes\n" * 99 + "a,b,c\n", "bytes.csv": head.encode() + b"yes,\xff\n", "empty.csv": "", "blank.csv": "\n",
             "columns.csv": "grammatical\nyes\n", "twice.csv": "grammatical_pred,grammatical,grammatical\nyes,no,x\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    found, rows = SRC.read_label_columns(spark, str(tmp_path))
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.path): r.error for r in found.collect()} == {
        "good one.csv": None, "open%20quote.csv": K.ERROR_OPEN_QUOTE, "long.csv": K.ERROR_TOO_MANY_FIELDS, "bytes.csv": K.ERROR_CHARSET,
        "empty.csv": K.ERROR_EMPTY_FILE, "blank.csv": K.ERROR_EMPTY_FILE, "columns.csv": K.ERROR_NO_PREDICTION, "twice.csv": None}
    got = sorted((name(r.path), r.truth, r.pred or "") for r in rows.collect())
    assert got == sorted([("good one.csv", "yes", "yes"), ("good one.csv", "no", "")] + [("good one.csv", "no", "no")] * 90 + [("twice.csv", "no", "yes")])


def test_a_table_with_a_faulty_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2\n')
    with pytest.raises(ValueError, match="a.csv"):
        SRC.read_csv(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception, match="a.csv"):
        SRC.read_csv(spark, str(tmp_path)).collect()


def test_empty_files_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert [r.path.rsplit("/", 1)[1] for r in SRC.file_list(spark, str(tmp_path)).collect()] == ["a.csv"]
    found, rows = SRC.read_label_columns(spark, str(tmp_path))
    assert [r.error for r in found.collect()] == [K.ERROR_EMPTY_FILE] and rows.count() == 0
