"""Catalog lookups by identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.ids import parse_id, parse_id_text


def lookup(papers: DataFrame, wanted: DataFrame, value: str = "value") -> DataFrame:
    """Resolve identifiers or URLs against the catalog; unresolved rows carry a ``problem``.

    Other columns of ``wanted``, such as the position of each value in a list, stay with their rows. Values
    that are no identifier do not take part in the join, so they never meet in one task.
    """
    asked = wanted.withColumn("_asked", parse_id(F.col(value))).withColumns({
        "id": F.col("_asked.base"), "_version": F.col("_asked.version")}).drop("_asked")
    valid = asked.where(F.col("id").isNotNull())
    found = valid.join(papers.withColumn("_found", F.lit(True)), "id", "left").unionByName(
        asked.where(F.col("id").isNull()), allowMissingColumns=True)
    problem = (
        F.when(F.col("id").isNull(), "invalid identifier")
        .when(F.col("_found").isNull(), "not in this catalog")
        .when(F.col("_version") != F.col("version"), "catalog describes another version"))
    return found.withColumn("problem", problem).drop("_found", "_version")


def get_paper(papers: DataFrame, value: str) -> DataFrame:
    """The one catalog row of an identifier typed by a user; raises when there is none.

    The literal filter reaches the scan, so only row groups that may hold the id are read.
    """
    base, version = parse_id_text(value)
    row = papers.where(F.col("id") == base)
    stored = row.select("version").first()
    if stored is None:
        raise ValueError(f"No paper {base} in the catalog; an update may bring it")
    if version and version != stored.version:
        raise ValueError(f"Catalog describes v{stored.version}; another version was asked for")
    return row
