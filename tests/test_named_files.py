import json

import pytest
from pyspark.sql import functions as F

from detlens.plans import views as V
from detlens.session import local_path
from detlens.sinks import named_files as NF

COLUMNS = ("sentence", "noun_phrase", "grammatical", "corrected", "grammatical_pred", "correction")


def test_predictions_under_their_derived_name(spark, tmp_path):
    rows = [(m, i, n, f"line\n{n}, \"q\"", "the cat", "yes", "the cat", "no", "") for m, i, k in (("org/a b", "d/x.csv", 300), ("m%2F+é", "x y.csv", 3), ("", "z", 1)) for n in range(k)]
    df = spark.createDataFrame(rows, "model string, input string, n int, sentence string, noun_phrase string, grammatical string, corrected string, "
                               "grammatical_pred string, correction string").repartition(7)
    for _ in range(2):  # a second time replaces the files
        manifest = NF.write_prediction_files(df, str(tmp_path), order=["n"])
    names = sorted(p.name for p in tmp_path.iterdir() if p.name[0] not in "._")
    assert names == ["m_2F___x y.csv__predictions.csv", "model__z__predictions.csv", "org_a_b__x.csv__predictions.csv"]
    assert sorted(r["name"] for r in manifest.collect()) == names
    assert {r["name"]: r["bytes"] for r in manifest.collect()} == {n: (tmp_path / n).stat().st_size for n in names}
    import csv

    with open(tmp_path / "org_a_b__x.csv__predictions.csv", newline="") as f:
        got = list(csv.reader(f))
    assert tuple(got[0]) == COLUMNS and [r[0] for r in got[1:]] == [f'line\n{n}, "q"' for n in range(300)]


def test_a_commit_can_be_taken_up(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"f{i}.txt", f"line {j}") for i in range(5) for j in range(3)], "name string, line string")
    real, calls = NF._hadoop, []

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename" and len(calls) == 3:
                raise RuntimeError("killed")
            if name == "rename":
                calls.append(1)
            return getattr(self.fs, name)

    monkeypatch.setattr(NF, "_hadoop", lambda spark, folder: (real(spark, folder)[0], Failing(real(spark, folder)[1])))
    with pytest.raises(RuntimeError, match="killed"):
        NF.write_named(df, F.col("name"), str(tmp_path), ["line"], ["line"], text=True)
    monkeypatch.setattr(NF, "_hadoop", real)
    staging = next(str(p) for p in tmp_path.iterdir() if p.name.startswith("_staging"))
    NF.commit(spark, str(tmp_path), staging)
    assert NF.commit(spark, str(tmp_path), staging).count() == 5
    assert all((tmp_path / f"f{i}.txt").read_text() == "line 0\nline 1\nline 2\n" for i in range(5))


def test_a_session_of_runs(spark, sf_dir, tmp_path):
    runs = V.runs(V.english_words(spark, sf_dir)).filter("run IN (3, 10)")
    manifest = NF.write_run_files(runs, str(tmp_path), "s1", order=("doc_id", "pos"), started="2024-01-01T00:00:00")
    names = {r["name"] for r in manifest.collect()}
    n = runs.select("script", "run").distinct().count()
    assert len(names) == 3 * n and all((tmp_path / x).exists() for x in names)
    some = next(x for x in names if x.endswith("run_03/run_info.json"))
    info = json.loads((tmp_path / some).read_text())
    assert info["seed"] == 3 and info["job_id"] is None and (tmp_path / some).with_name(info["predictions_file"]).exists()
    metrics = json.loads((tmp_path / some).with_name("metrics.json").read_text())
    assert set(metrics) == {"confusion", "metrics"}
    assert local_path(f"file://{tmp_path}") == str(tmp_path)
