"""Training-data pipeline over ``documents``: every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detlens.llm import stages
from detlens.session import materialize

#: (name, function(spark, docs, sf_dir) -> DataFrame). All but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.reject_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.decontaminate),
    ("mixing", stages.mix_sources),
    ("tokens", stages.write_tokens),
]

#: Learned scores and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
