"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import stages
from quillspark.llm.common import load
from quillspark.session import materialise

STAGES = [
    ("quality", stages.good_quality),
    ("near copies", stages.one_of_each),
    ("repeated passages", stages.without_repeats),
    ("mix", stages.to_weights),
    ("pieces", stages.as_pieces),
]

#: SQL cannot express the classifier, the fingerprints or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
