"""Adapters that give plain analytics tables the shape of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.ids import versioned
from quillspark.schema import PAPER_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, scanned as it lies; session settings decide how many tasks read it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` as a catalog row; ids stay unique for any number of rows."""
    c = F.col
    day = F.date_add(F.lit("2008-01-01").cast("date"), (c("doc_id") * 37 % 6570).cast("int"))
    first, version = day.cast("string"), (c("n_chars") % 3 + 1).cast("int")
    revised = F.date_add(day, (version - 1) * 30).cast("string")
    modern = F.concat(F.substring(first, 3, 2), F.substring(first, 6, 2), F.lit("."),
                      F.lpad(c("doc_id").cast("string"), 5, "0"))
    archive = F.concat(F.lit("x"), F.floor(c("doc_id") / 10_000_000).cast("string"), F.lit("/"),
                       F.lpad((c("doc_id") % 10_000_000).cast("string"), 7, "0"))
    cross = F.when(c("lang") != "en", F.concat(F.lit("physics."), c("lang")))
    topic = F.concat(F.lit("cs."), c("source"))
    columns = {
        "id": F.when(c("doc_id") < 100_000, modern).otherwise(archive),
        "version": version,
        "title": F.substring_index("text", "\n", 1),
        "abstract": c("text"),
        "published": F.concat(first, F.lit("T00:00:00Z")),
        "updated": F.concat(revised, F.lit("T00:00:00Z")),
        "authors": F.array(F.concat(F.lit("Desk "), c("source")), F.concat(F.lit("Room & "), c("lang"))),
        "categories": F.array_compact(F.array(topic, cross)),
        "primary_category": topic,
        "comment": F.lit(""),
        "doi": F.when(c("lang") == "de", F.concat(F.lit("10.5555/"), c("doc_id").cast("string"))
                      ).otherwise(""),
        "journal_ref": F.lit(""),
        "year_month": F.substring(first, 1, 7),
    }
    shaped = documents.select(
        *[columns[n].alias(n) for n in PAPER_COLUMNS if n in columns],
        (c("source") != "src17").alias("in_latest_search"))
    paper_version = versioned(c("id"), c("version"))
    return shaped.select(
        *[c(n) for n in PAPER_COLUMNS if n in columns and n != "year_month"],
        F.concat(F.lit(fixed.ABS_URL), paper_version).alias("abs_url"),
        F.concat(F.lit(fixed.PDF_URL), paper_version).alias("pdf_url"),
        "year_month", "in_latest_search")
