import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from detlens.llm import queries, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which some are toxic, near copies of others, or contaminated."""
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, words(rng, 30)) for i in range(5)]
    rows, toxic = [], []
    for i in range(300):
        w = words(rng, rng.randrange(20, 90)).split()
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = f"zxqq{rng.randrange(5)}"
        rows.append((i, " ".join(w), "en", f"s{i % 4}", None))
        toxic.append((i, 1 - i % 2, int(bad)))
    rows += [(400 + i, rows[i + 1][1] + " end", "en", "s1", 1) for i in range(7)]
    rows += [(500 + i, f"{words(rng, 40)} {items[i][1]}", "en", "s2", 1) for i in range(5)]
    rows += [(600, "zxqq1 zxqq2 zxqq3 " * 5, "en", "s0", 1), (None, words(rng, 30), None, None, None), (601, None, "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert queries.QUERIES.keys() >= {"op4_decontaminate", "op9_minhash_hamming"} and len(queries.QUERIES) == 13


def test_decisions_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    clean = stages.reject_toxic(spark, docs, folder)
    assert set(ids(docs)) - set(ids(clean)) >= {i for i in range(0, 300, 9)} | {600}
    assert len(set(ids(clean)) & {i for i in range(300) if i % 9}) >= 260
    single = stages.drop_near_duplicates(spark, docs, folder)
    assert set(ids(docs)) - set(ids(single)) == {400 + i for i in range(7)}
    pure = stages.decontaminate(spark, docs, folder)
    assert set(ids(docs)) - set(ids(pure)) == {500 + i for i in range(5)}
    assert all(df.columns == docs.columns for df in (clean, single, pure))


def test_near_duplicates_are_rows_not_ids(spark, folder):
    rng = random.Random(3)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " end"), (None, a + " other end"), (None, c), (None, c), (3, c + " end"), (1, a), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, folder).collect()]
    groups = [[t for _, t in kept if t and t.startswith(x)] for x in (a, b, c)]
    assert [len(g) for g in groups] == [1, 1, 1] and len(kept) == 5 and {(4, None), (4, ""), (1, b)} <= set(kept)


def test_mixing_repeats_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.unionByName(docs.filter("doc_id < 3"))
    mixed = stages.mix_sources(spark, twice, folder)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(v for k, v in counts.items() if k is None or k > 2) <= 3
    got = mixed.join(docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")), F.col("doc_id") == F.col("i"))
    assert got.filter("text <> t").count() == 0
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda w: w != ""))
    total = lambda df: df.agg(F.sum(size)).first()[0]
    assert abs(total(mixed) - total(twice)) <= 5 * 90


def test_stages_on_odd_rows(spark, folder, odd, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        out.collect()
        assert stage(spark, nothing, folder).count() == 0
    kept = [r.doc_id for r in stages.drop_near_duplicates(spark, odd, folder).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 5, 6, 9, 11, 12, 12]  # two texts have the id 12
    assert stages.write_tokens(spark, odd, folder).count() == odd.count()


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(docs.collect(), key=str) == sorted(corpus_pipeline.run(spark, folder).collect(), key=str)
