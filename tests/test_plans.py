"""Physical-plan properties the design relies on (checked on the small fixture)."""

import pytest

from detlens.plans import queries as Q

# Queries that only build a plan (the file-based ones write when they are built).
PLAN_ONLY = [
    "benchmark_metrics", "confusion_per_class", "confusion_columns", "prf_accuracy", "macro_f1",
    "confusion_regex", "metric_across_files", "metric_across_runs", "run_table_with_summary", "clean_text",
    "label_eval", "format_benchmark", "parse_reply", "reply_verdict", "final_verdict", "artifact_key",
    "edit_distance", "build_prompt", "classify_line", "neighbour_words", "next_word_model", "topk_next_word",
    "pos_tags", "iob_tags", "parse_pos_reply", "parse_iob_reply", "launch_manifest", "manifest_join",
]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_ONLY)
def test_no_cartesian_or_nested_loop_join(spark, sf_dir, name):
    plan = physical(Q.REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_has_no_python_but_nfkc(spark, sf_dir):
    plan = physical(Q.benchmark_metrics(spark, sf_dir))
    for node in ("BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan
    assert plan.count("ArrowEvalPython") == 1 and "ArrowEvalPython [normalize(" in plan
    assert "HashAggregate" in plan


def test_scan_prunes_columns_and_pushes_filter(spark, sf_dir):
    df = Q.pos_tags(spark, sf_dir)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text
    assert "n_chars" not in text  # the documents scan reads only what the query uses


def test_topk_uses_window_group_limit(spark, sf_dir):
    assert "WindowGroupLimit" in physical(Q.topk_next_word(spark, sf_dir))


def test_no_static_broadcast(spark, sf_dir):
    """Broadcasts may only appear after AQE measured a stage: the initial plan (before
    execution) joins by sort-merge, whatever the estimates say."""
    df = Q.next_word_model(spark, sf_dir)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    initial = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" in initial
    assert "BroadcastHashJoin" not in initial and "SortMergeJoin" in initial
