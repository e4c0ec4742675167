"""Ranking that ends early: blocks of papers that cannot reach the k-th best score are not read.

Current papers of like length form blocks. ``bounds`` tells for each term and block how many papers have it and the most
that it can add to a score there. The best blocks give k scores; of the others, only those are read whose bounds, added
over the query's terms, reach the least of these.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators.filters import current
from quillspark.operators.ordering import with_position
from quillspark.operators.postings import Index, bucket_of
from quillspark.operators.ranking import query_terms, rank_order, term_score

#: Papers in a block.
BLOCK = 64


class BlockIndex(NamedTuple):
    postings: DataFrame
    bounds: DataFrame
    papers: int
    avg_length: float
    buckets: int


def write_blocks(index: Index, path: str, size: int = BLOCK) -> None:
    """Write the postings of an index's current papers by term folder, term and block, and the bounds of the blocks."""
    docs = current(index.docs)
    placed = with_position(docs.select("id", "published", "doc_length"), [], [F.asc("doc_length"), F.asc("id")])
    blocks = placed.select("id", "published", "doc_length", F.floor(F.col("position") / size).cast("int").alias("block"))
    rows = index.postings.select("bucket", "term", "id", "tf", "in_title").join(blocks, "id")
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket")
     .parquet(f"{path}/postings"))
    written = index.docs.sparkSession.read.parquet(f"{path}/postings")
    bounds = written.groupBy("bucket", "term", "block").agg(
        F.count(F.lit(1)).alias("papers"), F.max("tf").alias("tf"), F.bool_or("in_title").alias("in_title"),
        F.min("doc_length").alias("doc_length"))
    (bounds.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket")
     .parquet(f"{path}/bounds"))
    docs.agg(F.count(F.lit(1)).alias("papers"), F.avg("doc_length").alias("avg_length")).withColumn(
        "buckets", F.lit(index.buckets)).write.parquet(f"{path}/corpus")


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    corpus = spark.read.parquet(f"{path}/corpus").first()
    return BlockIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/bounds"), *corpus)


def _of_terms(rows: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    numbers = rows.sparkSession.range(1).select(F.array(*[bucket_of(F.lit(t), buckets) for t in terms]).alias("b")).first().b
    return rows.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms))


def wanted_blocks(index: BlockIndex, query: str, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(hits of the best ``limit`` blocks, hits of those others that may hold one of the best ``limit`` papers), each with
    id, published and score. Every block that has a term holds a hit, so the first give ``limit`` scores if there are as
    many."""
    terms = query_terms(index.postings.sparkSession, query)
    bounds, rows = (_of_terms(t, terms, index.buckets) for t in (index.bounds, index.postings))
    counted = {r.term: r.df for r in bounds.groupBy("term").agg(F.sum("papers").alias("df")).collect()}

    def score(tf, in_title, length, term: str):
        return term_score(tf, in_title, length, F.lit(index.papers), F.lit(counted.get(term, 0)), F.lit(index.avg_length))

    def scores(found: DataFrame) -> DataFrame:
        by_paper = found.groupBy("id", "published", "doc_length").agg(*[c for i, t in enumerate(terms) for c in (
            F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}"),
            F.max(F.when(F.col("term") == t, F.col("in_title"))).alias(f"in_title_{i}"))])
        return by_paper.select("id", "published", reduce(add, (
            score(F.coalesce(f"tf_{i}", F.lit(0)), F.coalesce(f"in_title_{i}", F.lit(False)), F.col("doc_length"), t)
            for i, t in enumerate(terms))).alias("score"))

    # A score grows with tf and falls with the length, so this is the most that any paper of the block can have.
    most = reduce(add, (F.coalesce(F.max(F.when(F.col("term") == t, score(
        F.col("tf"), F.col("in_title"), F.col("doc_length"), t))), F.lit(0.0)) for t in terms))
    ranked = bounds.groupBy("block").agg(most.alias("most"))
    best = [r.block for r in ranked.orderBy(F.desc("most"), "block").limit(limit).collect()]
    first = scores(rows.where(F.col("block").isin(best)))
    least = first.orderBy(F.desc("score")).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
    reach = ranked.where(~F.col("block").isin(best))
    if least.n >= limit:
        reach = reach.where(F.col("most") >= least.s - 1e-9)
    return first, scores(rows.join(reach.select("block"), "block", "left_semi"))


def search(index: BlockIndex, query: str, limit: int = 12) -> DataFrame:
    """(id, published, score): the best ``limit`` of all current papers, as ``ranking.ranked`` finds them."""
    first, others = wanted_blocks(index, query, limit)
    return first.union(others).orderBy(*rank_order()).limit(limit)
