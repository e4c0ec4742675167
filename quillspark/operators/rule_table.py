"""Routing by a table of rules: terms and texts meet as n-grams of words, so thousands of rules cost one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.operators.routing import _WORD, _routed_text, boundary_pattern
from quillspark.session import materialise, spread

_GAP = _WORD.replace("[", "[^")
#: Terms of more words than this are matched by pattern.
MOST_WORDS = 6


def _grams(text: Column, sizes: list[int]) -> Column:
    """Every run of so many words of a text, with what stands between them as it is. A run begins and ends where a word
    does, so an n-gram is equal to a term exactly where the term stands between word boundaries. A match takes up one
    word and looks ahead at the others, so the next run begins at the next word."""
    def runs(size: int) -> Column:
        run = f"{_WORD}++(?:{_GAP}++{_WORD}++){{{size - 1}}}"
        return F.regexp_extract_all(text, F.lit(f"(?=({run})){_WORD}++"), F.lit(1))

    return F.array_distinct(reduce(F.concat, (runs(n) for n in sizes)))


def route(papers: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, topics) of every paper; ``rules`` holds position, topic and term (lower-case), in any number.

    topics are those of all terms that the title or abstract has between word boundaries, by position; without any, the
    fallback topic. Terms that begin and end with a word character and have few words are matched by an equi-join of
    n-grams, which the planner broadcasts while the table is small; the others, which are listed on the driver, by
    pattern.
    """
    plain = F.col("term").rlike(f"^{_WORD}") & F.col("term").rlike(f"{_WORD}$")
    # Stored, so that the planner knows how large the rules are before it deals out the n-grams, and rules that are
    # themselves the result of a query are made once.
    sized = materialise(rules.where("term <> ''").select(
        "position", "topic", "term", F.regexp_count("term", F.lit(f"{_WORD}+")).alias("size"), plain.alias("plain")))
    simple = F.col("plain") & (F.col("size") <= MOST_WORDS)
    sizes = sorted(r["size"] for r in sized.where(simple).select("size").distinct().collect())
    # Dealt out first: the texts may lie in few row groups, and cutting them into n-grams is most of the work.
    texts = spread(papers.select(F.col(key).alias("_k"), "title", "abstract"), "_k").select(
        "_k", _routed_text(F.col("title"), F.col("abstract")).alias("_text"))
    found = None
    if sizes:
        grams = texts.select("_k", F.explode(_grams(F.col("_text"), sizes)).alias("term"))
        found = grams.join(sized.where(simple).select("position", "topic", "term"), "term").select("_k", "position", "topic")
    for r in sized.where(~simple).select("position", "topic", "term").collect():
        own = texts.where(F.contains("_text", F.lit(r.term)) & F.col("_text").rlike(boundary_pattern(r.term))).select(
            "_k", F.lit(r.position).alias("position"), F.lit(r.topic).alias("topic"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return papers.select(key, F.array(F.lit(fixed.FALLBACK_TOPIC)).alias("topics"))
    topics = found.groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("position", "topic"))).alias("_found"))
    named = topics.select("_k", F.array_distinct(F.transform("_found", lambda f: f["topic"])).alias("topics"))
    return papers.select(key).join(named, F.col(key) == F.col("_k"), "left").select(
        key, F.coalesce("topics", F.array(F.lit(fixed.FALLBACK_TOPIC))).alias("topics"))
