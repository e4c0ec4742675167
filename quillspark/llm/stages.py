"""Operators as pipeline stages: each takes a table of documents and returns one.

A stage keeps every column of its input as it was, whatever the column's name; all but the text travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import byte_network, mixing, near_copies, pieces_bpe, substring_dedup
from quillspark.llm.common import load
from quillspark.llm.queries import ACCEPT, MIX_PATH, mix_weights, tokenizer_file, with_domain
from quillspark.session import materialise

MIX = {"budget_share": 0.9, "max_epochs": 4, "seed": 7}


def _packed(docs: DataFrame) -> DataFrame:
    """row, text and rest. row tells rows with equal ids and other texts, or without an id, apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return docs.select(row.alias("row"), "text", F.struct(*rest).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the byte network, fitted on the labels in ``sf_dir``, does not reject."""
    net = byte_network.fitted(docs, load(spark, sf_dir, "labels"))
    scored = byte_network.scored(_packed(docs).select("text", "rest"), net)
    return _unpacked(scored.filter(F.col("score") >= ACCEPT), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document with the least id; of a
    row that comes twice, one."""
    rows = _packed(docs)
    classes = materialise(near_copies.classes(rows, key="row"))
    others = classes.filter(F.col("row") != F.col("component_id")).select("row").distinct()
    kept = rows.join(others, "row", "left_anti")
    twice = materialise(classes.groupBy("row").count().filter("count > 1").select("row"))
    if not twice.isEmpty():
        again = kept.join(twice, "row", "left_semi").dropDuplicates(["row"])
        kept = kept.join(twice, "row", "left_anti").unionByName(again)
    return _unpacked(kept, docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated windows. A text that loses none stays as it is; one that loses
    some becomes its other words, joined by spaces, and n_chars follows; one that loses all goes."""
    kept = substring_dedup.without_repeats(_packed(docs), key="row").filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    rest = F.col("rest")
    if "n_chars" in docs.columns:
        length = F.when(cut, F.length("kept_text")).otherwise(rest["n_chars"]).cast(docs.schema["n_chars"].dataType)
        rest = rest.withField("n_chars", length)
    return _unpacked(kept.select(rest.alias("rest"), F.when(cut, F.col("kept_text")).otherwise(
        F.col("text")).alias("text")), docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = _packed(docs)
    sources = with_domain(rows.select("row", "text", "rest.lang", "rest.source"))
    mixed = mixing.mixed_rows(sources, mix_weights(spark), MIX_PATH, key="row", **MIX)
    copies = mixed.groupBy("row").agg(F.max("copies").alias("copies")).filter("copies > 0")
    times = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return _unpacked(rows.join(copies, "row").withColumn("time", F.explode(times)), docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and n_tokens, the ids and decoded, the text that they give; columns of the input with
    these names are replaced."""
    rows = pieces_bpe.encoded(_packed(docs).select("rest", "text"), tokenizer_file("piece_bpe_32k.model"))
    kept = [F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")]
    return rows.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
