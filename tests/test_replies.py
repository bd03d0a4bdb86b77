"""Golden rows for reply parsing (FIXTURES §3) and raw-line classes (FIXTURES §4)."""

import pytest

from detlens.functions.lines import classify_line, is_data_line
from detlens.functions.replies import predict

PHRASE = "cat"
ALT = "the cat"
# (reply, verdict, correction)
GOLDEN = [
    ("yes<EOT>", "yes", "cat"),
    ("YES: fine", "yes", "cat"),
    ("no the cat<EOT>", "no", "the cat"),
    ("no cat<EOT>", "yes", "cat"),
    ('No - "The cat."', "no", "The cat."),
    ("no <corrected noun phrase>", "yes", "cat"),
    ("no", "yes", "cat"),
    ("1. Answer: no a cat", "yes", "cat"),
    ("**Answer: no a cat", "no", "a cat"),
    ("B: the cat", "no", "the cat"),
    ("Because the cat", "no", "ecause the cat"),
    ("not sure", "no", "t sure"),
    ("", "yes", "cat"),
    ("I think no the cat", "yes", "cat"),
    ("Sentence: foo\nno the cat", "no", "the cat"),
    ("Respond no", "yes", "cat"),
    ("no: is the cat", "no", "the cat"),
    ("Yesterday", "yes", "cat"),
    ("2) no 3. “a cat”", "no", "a cat"),
    ("I say no the cat\nthanks", "no", "the cat"),
    ("<EOT> no", "yes", "cat"),
    ("no is is the cat", "no", "the cat"),
]


def test_golden_replies(spark):
    rows = [(i, r, PHRASE) for i, (r, _, _) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, reply string, noun_phrase string")
    got = {r["i"]: (r["grammatical_pred"], r["correction"]) for r in predict(df).collect()}
    for i, (reply, verdict, correction) in enumerate(GOLDEN):
        assert got[i] == (verdict, correction), (i, reply, got[i])


LINES = [
    ("s,np,yes,c,yes,np", "tp", "tp"),
    ("s,np,yes,c,no,fix", "fn", "fn"),
    ("s,np,no,c,yes,np", "fp", "fp"),
    ("s,np,no,c,no,fix", "tn", "tn"),
    ('s,np,no,"a, b",no,fix', None, None),
    ('"x, yes, y, no, z",np,no,c,yes,np', "fn", "fn"),
    ("s,np,maybe,c,no,f", None, None),
    ("s,np,YES,c, No ,f", "fn", None),
    ("s,np,no,,yes,np", "fp", "fp"),
]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_line_classes(spark, case_sensitive):
    df = spark.createDataFrame([(i, l) for i, (l, _, _) in enumerate(LINES)], "i int, line string")
    got = {r["i"]: r["c"] for r in df.select("i", classify_line("line", case_sensitive).alias("c")).collect()}
    for i, (line, insensitive, sensitive) in enumerate(LINES):
        assert got[i] == (sensitive if case_sensitive else insensitive), (line, got[i])


def test_header_and_blank_lines_skipped(spark):
    df = spark.createDataFrame([("Sentence,noun_phrase,x",), ("",), ("s,np,yes,c,yes,np",)], "line string")
    assert df.filter(is_data_line("line")).count() == 1
