import os
import time

import pytest
from pyspark.sql import functions as F

from detlens import constants as K
from detlens.operators import metrics as M
from detlens.session import shared_path
from detlens.streaming import run_metrics as ST

HEAD = "grammatical,grammatical_pred\n"


def write(root, run, rows, name="part-0.csv", script="job a", mtime=None):
    folder = root / f"script={script}" / "model=m" / "input=i.csv" / f"run={run}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(HEAD + "".join(f"{g},{p}\n" for g, p in rows))
    if mtime:
        os.utime(folder / name, (mtime, mtime))


def table(df):
    return {(r.script, r.run): (r.tp, r.fp, r.fn, r.tn) if r.error is None else r.error for r in df.collect()}


def test_a_replaced_file_takes_the_place_of_the_old_one(spark, tmp_path):
    root = tmp_path / "all runs 100%"
    stream = ST.RunMetrics(spark, str(root))
    assert stream.step().collect() == []  # the folder isn't there yet
    write(root, 1, [("yes", "yes")] * 3, mtime=1000)
    write(root, 1, [("no", "yes")], name="part-1.csv", mtime=1000)
    write(root, 2, [("yes", "no")], mtime=1000)
    assert table(stream.step()) == {("job a", 1): (3, 1, 0, 0), ("job a", 2): (0, 0, 1, 0)}
    assert ST.poll(spark, str(root), stream.arrivals) == 0
    # A newer version, one of the same time but another size, a part that is gone, and a broken file.
    write(root, 1, [("no", "no")] * 2, mtime=2000)
    (root / "script=job a/model=m/input=i.csv/run=1/part-1.csv").unlink()
    write(root, 2, [("yes", "yes")] * 4, mtime=1000)
    write(root, 3, [("yes", '"yes')], mtime=2000)
    after = stream.step()
    assert table(after) == {("job a", 1): (0, 0, 0, 2), ("job a", 2): (4, 0, 0, 0), ("job a", 3): K.ERROR_OPEN_QUOTE}
    assert {r.run: r.accuracy for r in after.collect()} == {1: 1.0, 2: 1.0, 3: None}
    write(root, 3, [("yes", "yes")], mtime=3000)
    assert table(stream.step())[("job a", 3)] == (1, 0, 0, 0)
    assert len(ST._versions(spark, stream.table)) == 2


def test_stream_equals_batch_after_every_change(spark, tmp_path):
    stream = ST.RunMetrics(spark, str(tmp_path / "runs"))
    truth = {}
    for step in range(3):
        for run in range(5):
            if (run + step) % 2 == 0:
                truth[run] = [("yes" if (i + run) % 2 else "no", "yes" if (i * step) % 3 else "no") for i in range(10 + run)]
                write(tmp_path / "runs", run, truth[run], mtime=1000 + step)
        rows = [("job a", run, g, p) for run, x in truth.items() for g, p in x]
        batch = M.confusion_columns(spark.createDataFrame(rows, "script string, run long, g string, p string"), "g", "p", group=("script", "run"))
        expected = {(r.script, r.run): (r.tp, r.fp, r.fn, r.tn) for r in batch.collect()}
        assert table(stream.step()) == expected


def test_many_changed_files_are_read_by_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "NAMED_FILES", 1)
    for run in range(4):
        write(tmp_path, run, [("yes", "yes")] * run, script="x[1]+{y}%")
    got = table(ST.stream_once(spark, str(tmp_path)))
    assert {k[1]: v[0] for k, v in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3}


def wait_for(spark, folder, ready, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        got = table(ST.run_metrics_table(spark, folder))
        if ready(got):
            return got
        time.sleep(1)
    pytest.fail(f"not in time: {got}")


def test_waiting_has_a_limit(spark, tmp_path):
    home = shared_path(spark, "t-wait")
    arrivals, folder = f"{home}/arrivals", f"{home}/table"
    launched = spark.createDataFrame([("job a", "m", "i.csv", 1), ("job a", "m", "i.csv", 2)], "script string, model string, input string, run long")
    ST.expect(launched.withColumn("launched", F.timestamp_seconds(F.lit(5000))), arrivals)
    write(tmp_path, 1, [("yes", "yes")], mtime=6000)
    write(tmp_path, 2, [("yes", "yes")], mtime=4000)  # an earlier run's file: older than the launch
    ST.poll(spark, str(tmp_path), arrivals)
    query = ST.start_run_metrics(spark, arrivals, folder, f"{home}/ckpt", available_now=False, limit_sec=4, every="1 second")
    try:
        got = wait_for(spark, folder, lambda t: t.get(("job a", 2)) == K.ERROR_TIMEOUT)
        assert got[("job a", 1)] == (1, 0, 0, 0)
        write(tmp_path, 2, [("no", "no")] * 2, mtime=7000)  # it comes after all
        ST.poll(spark, str(tmp_path), arrivals)
        wait_for(spark, folder, lambda t: t.get(("job a", 2)) == (0, 0, 0, 2))
    finally:
        query.stop()
