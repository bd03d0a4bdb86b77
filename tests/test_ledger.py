import os
import uuid
from collections import Counter

import pytest

from detlens.operators import ledger
from detlens.plans.scoring_run import run_scoring
from detlens.session import shared_path

SCHEMA = "k long, t string"


def recording(folder, fail_at=None):
    """A scorer that records every row that it is asked about, and fails at a row."""

    class Scorer:
        def score(self, batch, seed=0):
            if fail_at is not None and (batch["t"] == fail_at).any():
                raise RuntimeError("killed")
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(batch["t"].fillna("null")))
            return batch["t"].fillna("null") + "!"

    return Scorer


def asked(folder):
    return Counter(t for name in os.listdir(folder) for t in open(os.path.join(folder, name)).read().split("\n"))


def test_a_killed_run_goes_on_without_asking_again(spark, tmp_path):
    rows = [(i, f"row {i}") for i in range(400)] + [(None, None), (7, "row 7 again"), (None, "no key")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder = shared_path(spark, "t-ledger")
    calls = [str(tmp_path / x) for x in ("one", "two", "three")]
    for c in calls:
        os.mkdir(c)
    with pytest.raises(Exception, match="killed"):
        ledger.score_once(df, recording(calls[0], "row 333"), folder, ["k", "t"], batches=8)
    schema = ledger.T.StructType([*df.schema.fields, ledger.T.StructField("reply", ledger.T.StringType())])
    committed = {r.t for r in ledger.committed_rows(spark, folder, schema).collect()}
    assert 0 < len(committed) < len(rows)
    out = ledger.score_once(df, recording(calls[1]), folder, ["k", "t"], batches=8).collect()
    assert sorted(((r.k, r.t) for r in out), key=str) == sorted(rows, key=str) and all(r.reply == f"{r.t or 'null'}!" for r in out)
    second = asked(calls[1])
    assert not committed & set(second) and max(second.values()) == 1 and len(committed) + len(second) == len(rows)
    # Nothing is left to do; a row that is new to the input is taken up alone.
    more = spark.createDataFrame(rows + [(1000, "new")], SCHEMA)
    assert ledger.score_once(more, recording(calls[2]), folder, ["k", "t"], batches=8).count() == len(rows) + 1
    assert asked(calls[2]) == {"new": 1}


def test_a_folder_without_a_mark_does_not_count(spark, tmp_path):
    df = spark.createDataFrame([(i, f"row {i}") for i in range(20)], SCHEMA)
    folder = shared_path(spark, "t-ledger")
    ledger.score_once(df, recording(str(tmp_path)), folder, ["k"], batches=2)
    from detlens.session import local_path

    os.remove(f"{local_path(folder)}/batch=1/_SUCCESS")
    out = ledger.score_once(df, recording(str(tmp_path)), folder, ["k"], batches=2).collect()
    assert sorted(r.k for r in out) == list(range(20))


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    out = ledger.score_once(df, recording(str(tmp_path)), shared_path(spark, "t-ledger"), ["k"])
    assert out.columns == ["k", "t", "reply"] and out.count() == 0


def test_a_scoring_run_is_taken_up(spark, tmp_path):
    folder, out = str(tmp_path), shared_path(spark, "t-run")
    rows = [(f"the cat {i}", "cat", "no", "the cat") for i in range(30)]
    bench = spark.createDataFrame(rows, "sentence string, noun_phrase string, grammatical string, corrected string")

    class Scorer:
        def score(self, batch, seed=0):
            open(os.path.join(folder, uuid.uuid4().hex), "w").write("x" * len(batch))
            return batch["noun_phrase"].map(lambda n: f"no the {n}")

    count = lambda: sum(len(open(os.path.join(folder, n)).read()) for n in os.listdir(folder))
    first = run_scoring(bench, Scorer, out, "m", "i.csv", batches=3).first()
    assert count() == 30 and first["tp_no"] == 30
    assert run_scoring(bench, Scorer, out, "m", "i.csv", batches=3, resume=True).first()["tp_no"] == 30 and count() == 30
    run_scoring(bench, Scorer, out, "m", "i.csv", batches=3)
    assert count() == 60
