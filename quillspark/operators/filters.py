"""Filters shared by search, views and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.operators.routing import in_topic


def is_current() -> Column:
    """A missing flag counts as current."""
    return F.coalesce(F.col("in_latest_search"), F.lit(True))


def current(papers: DataFrame) -> DataFrame:
    return papers.where(is_current())


def restrict(papers: DataFrame, topic: str | None = None, year: int | None = None,
             include_missing: bool = False, rules=fixed.TOPIC_RULES) -> DataFrame:
    """Currentness, year-prefix and topic filters, cheapest first."""
    if not include_missing:
        papers = current(papers)
    if year:
        papers = papers.where(F.col("year_month").startswith(str(year)))
    if topic:
        routed = (F.array_contains("topics", topic) if "topics" in papers.columns
                  else in_topic(F.col("title"), F.col("abstract"), topic, rules))
        papers = papers.where(routed)
    return papers
