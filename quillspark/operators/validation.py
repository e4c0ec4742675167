"""Checks a scan has to pass before anything is committed.

A scan is two tables. ``pages``: requested ``offset``, reported ``total`` and ``start``, ``n_papers``
and ``error``. ``entries``: ``offset`` plus the paper columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.text import is_iso_time, subject


def page_problem(page_size: int) -> Column:
    """The first broken rule of a page, or NULL."""
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((F.col("total") < 0) | (F.col("start") < 0), "Invalid pagination values")
        .when(F.col("total") > fixed.MAX_TOTAL_RESULTS, "Search exceeds the API result window")
        .when((F.col("start") != F.col("offset"))
              | ((F.col("n_papers") == 0) & (F.col("offset") < F.col("total")))
              | (F.col("n_papers") > page_size), "Unexpected or empty page"))


def in_scope(subjects: list[str]) -> Column:
    """Whether any category belongs to a configured subject."""
    return F.exists("categories", lambda c: subject(c).isin(subjects))


def metadata_problem() -> Column:
    """The first missing or malformed mandatory field of an entry, or NULL."""
    return (
        F.when(F.col("version").isNull(), "Version missing")
        .when((F.col("title") == "") | (F.col("abstract") == "") | (F.size("categories") == 0),
              "Incomplete metadata")
        .when(~is_iso_time(F.col("published")) | ~is_iso_time(F.col("updated")), "Malformed timestamp"))


def page_problems(pages: DataFrame, page_size: int) -> DataFrame:
    return pages.withColumn("problem", page_problem(page_size)).where("problem IS NOT NULL").select(
        "offset", "problem")


def out_of_scope(entries: DataFrame, subjects: list[str]) -> DataFrame:
    return entries.where(~in_scope(subjects))


def duplicate_ids(entries: DataFrame) -> DataFrame:
    """Ids that occur more than once in a scan; counted on the map side first."""
    return entries.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def scan_summary(pages: DataFrame, entries: DataFrame, page_size: int,
                 subjects: list[str]) -> DataFrame:
    """One row with every whole-scan check as a count or flag."""
    page_side = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(page_problem(page_size).isNotNull()).alias("bad_pages"),
        (F.min("total") == F.max("total")).alias("total_is_stable"),
        F.max("total").alias("total"))
    by_id = entries.groupBy("id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(metadata_problem().isNotNull()).alias("incomplete"),
        F.count_if(~in_scope(subjects)).alias("out_of_scope"))
    entry_side = by_id.agg(
        F.count(F.lit(1)).alias("unique_ids"),
        F.count_if(F.col("copies") > 1).alias("duplicate_ids"),
        F.coalesce(F.sum("incomplete"), F.lit(0)).alias("incomplete"),
        F.coalesce(F.sum("out_of_scope"), F.lit(0)).alias("out_of_scope"))
    page_row = F.struct(*page_side.columns)
    entry_row = entry_side.select(F.struct(*entry_side.columns)).scalar()
    return (page_side.select(page_row.alias("p")).withColumn("e", entry_row)
            .select("p.*", "e.*")
            .withColumn("unique_matches_total", F.col("unique_ids") == F.col("total")))
