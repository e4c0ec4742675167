"""Chunk files, manifests and cache checks of extracted full texts.

``documents`` has one row per full text: id, version, title, source_url, format, warnings,
source_sha256 and ``chunks`` (array<struct<text, sections>>). A document's chunks live in its own row,
so numbering, hashing and the manifest need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import render
from quillspark.functions.ids import file_key, versioned
from quillspark.functions.text import sha256, truncated


def single_section(texts: Column, section: Column) -> Column:
    """Plain chunk texts as the ``chunks`` column of one section."""
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.array(section).alias("sections")))


def _label(sections: Column) -> Column:
    return F.array_join(sections, " / ")


def chunk_files(documents: DataFrame) -> DataFrame:
    """One row per chunk file: number from 1, path, sections, size, body and its hash."""
    numbered = documents.select(
        "id", "version", "source_url", F.posexplode("chunks").alias("_pos", "chunk"))
    number = F.col("_pos") + 1
    rows = numbered.select(
        "id", "version", number.alias("chunk_no"), render.chunk_path(number).alias("path"),
        F.col("chunk.sections").alias("sections"), F.length("chunk.text").alias("chars"),
        render.chunk_body(F.col("source_url"), number, _label(F.col("chunk.sections")),
                          F.col("chunk.text")).alias("body"))
    return rows.withColumn("sha256", sha256(F.col("body")))


def manifests(documents: DataFrame, stamp: str) -> DataFrame:
    """(id, version, contents, manifest struct) of every document."""
    def entry(chunk: Column, position: Column) -> Column:
        number = position + 1
        body = render.chunk_body(F.col("source_url"), number, _label(chunk["sections"]), chunk["text"])
        return F.struct(
            render.chunk_path(number).alias("path"), chunk["sections"].alias("sections"),
            F.length(chunk["text"]).alias("chars"), sha256(body).alias("sha256"))
    rows = F.transform("chunks", lambda c, i: render.contents_row(
        i + 1, _label(c["sections"]), F.length(c["text"])))
    contents = render.contents_page(
        F.col("title"), versioned(F.col("id"), F.col("version")), F.col("source_url"), stamp,
        F.col("warnings"), rows)
    manifest = F.struct(
        F.col("id").alias("arxiv_id"), "version", "source_url", "format",
        F.lit(stamp).alias("fetched_at"), "warnings", "source_sha256",
        F.transform("chunks", entry).alias("chunks"))
    return documents.select("id", "version", contents.alias("contents"), manifest.alias("manifest"))


def cache_state(manifest_rows: DataFrame, stored_files: DataFrame) -> DataFrame:
    """(id, version, valid): valid when there is a chunk and every chunk's stored body matches its hash.

    ``stored_files`` needs id, version, path and body. Partial aggregation keeps a text with very many
    chunks from meeting in one task.
    """
    key = ["id", "version", "path"]
    expected = manifest_rows.select(
        "id", "version", (F.col("contents").isNotNull()).alias("has_contents"),
        F.explode_outer("manifest.chunks").alias("c")
    ).select("id", "version", "has_contents", F.col("c.path").alias("path"), F.col("c.sha256").alias("want"))
    actual = stored_files.select(*key, sha256(F.col("body")).alias("have"))
    matched = expected.join(actual, key, "left")
    intact = F.col("has_contents") & F.coalesce(F.col("want") == F.col("have"), F.lit(False))
    return matched.groupBy("id", "version").agg(F.bool_and(intact).alias("valid"))


def to_fetch(papers: DataFrame, states: DataFrame) -> DataFrame:
    """Papers whose current version has no valid cache."""
    valid = states.where("valid").select("id", "version")
    return papers.join(valid, ["id", "version"], "left_anti")


def cached_current(papers: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Papers with a manifest of their current version (existence only)."""
    return papers.join(manifest_rows.select("id", "version"), ["id", "version"], "left_semi")


def read_chunks(manifest_rows: DataFrame, stored_files: DataFrame, wanted: DataFrame,
                max_chars: int = 8000) -> DataFrame:
    """Text of the wanted chunks (id, version, chunk_no), cut to the budget, or a ``problem``."""
    asked = wanted.join(manifest_rows, ["id", "version"], "left")
    count = F.size("manifest.chunks")
    item = F.get("manifest.chunks", F.col("chunk_no") - 1)
    located = asked.select(
        "id", "version", "chunk_no", item["path"].alias("path"), item["sha256"].alias("want"),
        F.when(F.col("manifest").isNull(), "version is not cached")
        .when((F.col("chunk_no") < 1) | (F.col("chunk_no") > count),
              F.concat(F.lit("chunk must be between 1 and "), count.cast("string"))).alias("problem"))
    files = stored_files.select("id", "version", "path", "body")
    joined = located.join(files, ["id", "version", "path"], "left")
    intact = F.coalesce(sha256(F.col("body")) == F.col("want"), F.lit(False))
    problem = F.coalesce("problem", F.when(~intact, "cache missing or corrupt"))
    return joined.withColumn("problem", problem).select(
        "id", "version", "chunk_no",
        F.when(F.col("problem").isNull(), truncated(F.col("body"), max_chars)).alias("text"), "problem")


def folder(base: Column, version: Column) -> Column:
    """The library folder of one paper version."""
    key = file_key(base)
    return F.concat(F.lit("papers/"), key, F.lit("/"), versioned(key, version))


def html_source(base: Column, version: Column) -> Column:
    return F.concat(F.lit(fixed.HTML_URL), versioned(base, version))
