"""The report's files may be compressed; its lines are the same."""

import os

from detlens.sinks import writers as SNK


def test_a_compressed_report_has_the_same_lines(spark, tmp_path):
    df = spark.createDataFrame([(i, f" word{i} " * 500, f" word{i} [EXTRA DET:a] " * 500) for i in range(20)], "doc_id long, sentence string, output string")
    size, lines = {}, {}
    for kind in ("none", "gzip"):
        SNK.write_report(df, f"{tmp_path}/{kind}", compression=kind)
        size[kind] = sum(os.path.getsize(f"{tmp_path}/{kind}/{f}") for f in os.listdir(f"{tmp_path}/{kind}"))
        lines[kind] = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/{kind}").collect())
    assert lines["gzip"] == lines["none"] and len(lines["gzip"]) == 20 * 4
    assert size["gzip"] * 5 < size["none"]
