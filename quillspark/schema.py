"""Schemas of the catalog and of the full-text tables."""

from pyspark.sql import types as T

PAPER_FIELDS = [
    T.StructField("id", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("abstract", T.StringType(), False),
    T.StructField("published", T.StringType(), False),
    T.StructField("updated", T.StringType(), False),
    T.StructField("authors", T.ArrayType(T.StringType()), False),
    T.StructField("categories", T.ArrayType(T.StringType()), False),
    T.StructField("primary_category", T.StringType(), False),
    T.StructField("comment", T.StringType(), False),
    T.StructField("doi", T.StringType(), False),
    T.StructField("journal_ref", T.StringType(), False),
    T.StructField("abs_url", T.StringType(), False),
    T.StructField("pdf_url", T.StringType(), False),
    T.StructField("year_month", T.StringType(), False),
]
PAPER = T.StructType(PAPER_FIELDS)
PAPER_COLUMNS = [f.name for f in PAPER_FIELDS]

SEEN_FIELDS = [
    T.StructField("first_seen", T.StringType(), False),
    T.StructField("last_seen", T.StringType(), False),
    T.StructField("in_latest_search", T.BooleanType(), True),
]
CATALOG = T.StructType(PAPER_FIELDS + SEEN_FIELDS)

BLOCKS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()),
]))

CHUNKS = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StringType())),
]))

EXTRACTED_BLOCKS = T.StructType([
    T.StructField("blocks", BLOCKS), T.StructField("error", T.StringType())])
EXTRACTED_PAGES = T.StructType([
    T.StructField("blocks", BLOCKS),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType())])
EXTRACTED_CHUNKS = T.StructType([
    T.StructField("chunks", CHUNKS), T.StructField("error", T.StringType())])
