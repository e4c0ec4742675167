"""Keyword routing of papers to topics."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.text import let

_WORD = r"[\p{L}\p{N}_]"


def boundary_pattern(term: str) -> str:
    """The term between Unicode word boundaries (letters, digits and '_' are word characters)."""
    def is_word(char: str) -> bool:
        return char.isalnum() or char == "_"
    literal = re.escape(term)
    # The literal comes first, so that the matcher can search for it before it tests the edges.
    before = f"(?<{'!' if is_word(term[0]) else '='}{_WORD}{literal})"
    after = f"(?{'!' if is_word(term[-1]) else '='}{_WORD})"
    return literal + before + after


def _mentions(text: Column, terms: list[str]) -> Column:
    # The plain substring test is far cheaper than the pattern and almost always decides.
    return reduce(or_, (F.contains(text, F.lit(t)) & text.rlike(boundary_pattern(t)) for t in terms))


def _routed_text(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat(title, F.lit(" "), abstract))


def topic_ids(title: Column, abstract: Column, rules=fixed.TOPIC_RULES) -> Column:
    """Topic ids in rule order; the fallback topic when no rule matches."""
    def matching(text: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(_mentions(text, terms), F.lit(topic)) for topic, _, terms in rules if terms]))
    def with_fallback(found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fixed.FALLBACK_TOPIC)))
    return let(_routed_text(title, abstract), lambda text: let(matching(text), with_fallback))


def in_topic(title: Column, abstract: Column, topic: str, rules=fixed.TOPIC_RULES) -> Column:
    """Whether a paper is routed to one topic; tests no more terms than that needs."""
    wanted = [terms for name, _, terms in rules if name == topic and terms]
    if topic == fixed.FALLBACK_TOPIC:
        every = [t for _, _, terms in rules for t in terms]
        return ~let(_routed_text(title, abstract), lambda text: _mentions(text, every))
    if not wanted:
        return F.lit(False)
    return let(_routed_text(title, abstract), lambda text: _mentions(text, wanted[0]))


def with_topics(papers: DataFrame, rules=fixed.TOPIC_RULES) -> DataFrame:
    if "topics" in papers.columns:
        return papers
    return papers.withColumn("topics", topic_ids(F.col("title"), F.col("abstract"), rules))
