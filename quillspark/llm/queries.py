"""The registered queries: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import (
    byte_network, filter_audit, importance, labelled, mixing, oracle, pieces_bpe, secret_spans, sharding, simhash,
    substring_dedup, token_files, toxicity, weak_rules, winnowing)
from quillspark.llm.common import load

SHARDS = 24


def rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = weak_rules.judged(load(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(load(spark, folder, "documents"), [1.0] * SHARDS)


#: The tree of the mix: a source belongs to a domain; what a table does not name has weight 1.
DOMAINS = ["web", "books", "code", "forums"]
MIX_PATH = ["domain", "lang", "source"]
MIX_WEIGHTS = [
    ("web", None, None, 4), ("books", None, None, 3), ("code", None, None, 2), ("forums", None, None, 1),
    *[(d, lang, None, w) for d in DOMAINS for lang, w in (("en", 6), ("fr", 2), ("de", 2), ("es", 2))]]


MIX = {"budget_share": 0.8, "max_epochs": 4, "seed": 7}


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a document, from the number in its source's name; sources without one are 'web'."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).cast("bigint"), F.lit(0))
    return docs.withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]),
                                                  (F.pmod(number, F.lit(4)) + 1).cast("int")))


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "domain string, lang string, source string, weight bigint")


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_domain(load(spark, folder, "documents"))
    return mixing.mixed_rows(docs, mix_weights(spark), MIX_PATH, **MIX)


def substring(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.without_repeats(load(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Scores from here on count as label 1.
ACCEPT = 0.3


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity.scored(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    scores = byte_network.scored(docs, byte_network.fitted(docs, load(spark, folder, "labels")))
    return scores.select("doc_id", F.coalesce(labelled.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    classes = simhash.near_classes(load(spark, folder, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                          "component_id")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def winnowed(spark: SparkSession, folder: str) -> DataFrame:
    rows = winnowing.compared(load(spark, folder, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", winnowing.as_text("hashes").alias("fingerprint"),
                       winnowing.as_text("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next",
                       *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positions", "edited_positions")])


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.stored(load(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def piece_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    rows = pieces_bpe.encoded(docs, tokenizer_file("piece_bpe_32k.model"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def audited(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


def towards_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_spans.secret_spans(load(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_super_k_mers": substring,
    "op2_weak_rules": rules,
    "op3_rendezvous_shards": shards,
    "op4_counterfactual_toxicity": toxic,
    "op5_winnowing": winnowed,
    "op6_hierarchical_mix": mixture,
    "op7_deletion_variants": near_copies,
    "op8_orc_tokens": tokens,
    "op9_piece_agenda": piece_ids,
    "op10_byte_network": quality,
    "op11_byte_transducer": audited,
    "op12_head_tail_vocabulary": towards_benchmark,
    "op13_markov_secrets": secrets,
}

ORACLE: dict[str, str] = {
    "op1_super_k_mers": oracle.SUBSTRING,
    "op2_weak_rules": oracle.RULES,
    "op6_hierarchical_mix": oracle.mixture(MIX_PATH, DOMAINS, MIX_WEIGHTS, MIX["budget_share"], MIX["max_epochs"],
                                           MIX["seed"]),
    "op11_byte_transducer": oracle.FILTER_AUDIT,
    "op12_head_tail_vocabulary": oracle.importance(importance.BUCKETS, importance.PERCENT, importance.LEAST_WORDS,
                                                   importance.SEED),
}
