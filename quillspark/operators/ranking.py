"""BM25 ranking with a title boost."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.text import content_words, let, singular, tokens
from quillspark.operators.filters import restrict
from quillspark.session import materialise

_RANK_KEYS = ("score", "published", "id")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct search tokens of a query, sorted; raises when there is none."""
    row = spark.range(1).select(F.array_sort(F.array_distinct(tokens(F.lit(query)))).alias("t")).first()
    if not row.t:
        raise ValueError("The query has no searchable words; use English keywords or known Chinese terms")
    return row.t


def _query_words(words: Column, terms: list[str]) -> Column:
    """The words of a text that reduce to a query term, reduced."""
    # Only these raw forms can reduce to a term, so only they need the singular rule.
    forms = {*terms, *(t + "s" for t in terms), *(plural for plural, _ in fixed.IRREGULAR_PLURALS)}
    candidates = F.transform(F.filter(words, lambda w: w.isin(sorted(forms))), singular)
    return F.filter(candidates, lambda w: w.isin(terms))


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _measures(terms: list[str]) -> Column:
    """struct<doc_length, tf, in_title> of a paper; tf and in_title hold one element per term."""
    def measured(title: Column, abstract: Column, in_title: Column, in_abstract: Column) -> Column:
        return F.struct(
            (fixed.TITLE_WEIGHT * F.size(title) + F.size(abstract)).alias("doc_length"),
            F.array(*[fixed.TITLE_WEIGHT * _occurrences(in_title, t) + _occurrences(in_abstract, t)
                      for t in terms]).alias("tf"),
            F.array(*[F.array_contains(in_title, t) for t in terms]).alias("in_title"))
    return let(content_words(F.col("title")), lambda title: let(
        content_words(F.col("abstract")), lambda abstract: let(
            _query_words(title, terms), lambda in_title: let(
                _query_words(abstract, terms), lambda in_abstract: measured(
                    title, abstract, in_title, in_abstract)))))


def term_statistics(papers: DataFrame, terms: list[str]) -> DataFrame:
    """Add ``m``: the weighted length and, per query term, weighted frequency and title membership."""
    return papers.withColumn("m", _measures(terms))


def corpus_statistics(docs: DataFrame, n_terms: int) -> DataFrame:
    """One row: document count, average length and the document frequency of every query term."""
    return docs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("m.doc_length").alias("avg_length"),
        *[F.count_if(F.col("m.tf")[i] > 0).alias(f"df_{i}") for i in range(n_terms)])


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def damping(tf: Column, doc_length: Column, avg_length: Column) -> Column:
    return tf + fixed.BM25_K1 * ((1 - fixed.BM25_B) + fixed.BM25_B * doc_length / avg_length)


def term_score(tf: Column, in_title: Column, doc_length: Column, n: Column, df: Column,
               avg_length: Column) -> Column:
    weight = idf(n, df)
    frequency_part = F.when(tf > 0, weight * tf * (fixed.BM25_K1 + 1) / damping(tf, doc_length, avg_length)).otherwise(0.0)
    return frequency_part + F.when(in_title, fixed.TITLE_BOOST * weight).otherwise(0.0)


def scored(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Every paper with a query term, with its score (terms summed in sorted order). ``docs`` holds ``m``; it is read
    twice, so it should be stored."""
    names = ["n", "avg_length", *[f"df_{i}" for i in range(len(terms))]]
    # An uncorrelated scalar subquery: one aggregate row reaches the scoring pass as a constant.
    stats = corpus_statistics(docs, len(terms)).select(F.struct(*names)).scalar()
    hits = docs.where(F.exists("m.tf", lambda n: n > 0)).withColumn("_stats", stats)
    total = reduce(add, (
        term_score(F.col("m.tf")[i], F.col("m.in_title")[i], F.col("m.doc_length"),
                   F.col("_stats.n"), F.col(f"_stats.df_{i}"), F.col("_stats.avg_length"))
        for i in range(len(terms))))
    return hits.withColumn("score", total)


def rank_order() -> list[Column]:
    return [F.desc(key) for key in _RANK_KEYS]


def ranked(papers: DataFrame, query: str, limit: int | None = 12, topic: str | None = None, year: int | None = None,
           include_missing: bool = False, rules=fixed.TOPIC_RULES) -> DataFrame:
    """(id, published, score) of the papers that a query finds. Corpus statistics cover the filtered papers only.

    Texts are read and tokenised once: their lengths and term counts are stored, a few numbers for each paper, and the
    statistics, scores and top-k come from those.
    """
    terms = query_terms(papers.sparkSession, query)
    chosen = restrict(papers, topic, year, include_missing, rules)
    measured = materialise(term_statistics(chosen, terms).select("id", "published", "m"))
    found = scored(measured, terms).select("id", "published", "score")
    return found if limit is None else found.orderBy(*rank_order()).limit(limit)


def search(papers: DataFrame, query: str, limit: int | None = 12, topic: str | None = None,
           year: int | None = None, include_missing: bool = False,
           rules=fixed.TOPIC_RULES) -> DataFrame:
    """``ranked`` with all columns of the papers, whose ids have to be unique."""
    top = ranked(papers, query, limit, topic, year, include_missing, rules)
    return papers.join(top.select("id", "score"), "id").select(*papers.columns, "score")


def numbered(top: DataFrame) -> DataFrame:
    """Add the 1-based rank to an already limited (at most 50 rows) result."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))
