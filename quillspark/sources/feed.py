"""Atom result pages to typed tables, parsed by Spark's own XML reader function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.ids import parse_id, versioned
from quillspark.functions.text import clean, is_iso_time, year_month
from quillspark.schema import PAPER_COLUMNS

ENTRY_SCHEMA = """
  totalResults string, startIndex string,
  entry array<struct<
    id string, title string, summary string, published string, updated string,
    author array<struct<name string>>, category array<struct<_term string>>,
    primary_category struct<_term string>, comment string, doi string, journal_ref string>>,
  malformed string
"""
XML_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": "malformed"}
# The document element has to be a feed in the Atom namespace.
FEED_ROOT = (r'\A\s*(<\?[^>]*\?>\s*|<!--(?s:.*?)-->\s*)*<([A-Za-z_][\w.-]*:)?feed\b[^>]*'
             r'xmlns(:[\w.-]+)?\s*=\s*["\']http://www\.w3\.org/2005/Atom["\']')

FEED_CLOSED = r"</([A-Za-z_][\w.-]*:)?feed\s*>"
FEED_END = FEED_CLOSED + r"\s*(<!--(?s:.*?)-->\s*)*\z"
NO_MARKUP = r"<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>"


def _paper(entry: Column) -> Column:
    parsed = parse_id(entry["id"])
    categories = F.array_sort(F.array_distinct(F.array_compact(
        F.transform(F.coalesce(entry["category"], F.array()), lambda c: c["_term"]))))
    authors = F.transform(F.coalesce(entry["author"], F.array()), lambda a: clean(a["name"]))
    published = F.coalesce(entry["published"], F.lit(""))
    paper_version = versioned(parsed["base"], parsed["version"])
    fields = {
        "id": parsed["base"], "version": parsed["version"].try_cast("int"),
        "title": clean(entry["title"]), "abstract": clean(entry["summary"]),
        "published": published, "updated": F.coalesce(entry["updated"], F.lit("")),
        "authors": authors, "categories": categories,
        "primary_category": F.coalesce(entry["primary_category"]["_term"], F.lit("")),
        "comment": clean(entry["comment"]), "doi": clean(entry["doi"]),
        "journal_ref": clean(entry["journal_ref"]),
        "abs_url": F.concat(F.lit(fixed.ABS_URL), paper_version),
        "pdf_url": F.concat(F.lit(fixed.PDF_URL), paper_version),
        "year_month": year_month(published),
    }
    return F.struct(*[fields[name].alias(name) for name in PAPER_COLUMNS])


def parse_pages(raw_pages: DataFrame) -> DataFrame:
    """(offset, raw) to (offset, total, start, entry array, error). Bad pages get an error text."""
    feed = F.from_xml("raw", F.lit(ENTRY_SCHEMA), XML_OPTIONS)
    error_entry = F.filter("feed.entry", lambda e: F.contains(e["id"], F.lit(fixed.API_ERROR_MARK)))
    pages = raw_pages.withColumn("feed", feed).select(
        "offset",
        F.col("feed.totalResults").try_cast("int").alias("total"),
        F.col("feed.startIndex").try_cast("int").alias("start"),
        F.coalesce("feed.entry", F.array()).alias("entry"),
        F.when(~F.col("raw").rlike(FEED_ROOT) | ~F.col("raw").rlike(FEED_END)
               # A second document element would follow the end of the first.
               | (F.regexp_count(F.regexp_replace("raw", NO_MARKUP, ""), F.lit(FEED_CLOSED)) != 1)
               | F.col("feed").isNull() | F.col("feed.malformed").isNotNull(),
               "Response is not an Atom feed")
        .when(F.size(error_entry) > 0, F.concat(F.lit("API error: "), F.coalesce(
            F.get(error_entry, 0)["summary"], F.lit("unknown")))).alias("error"))
    return pages.withColumn("error", F.coalesce("error", F.when(
        F.col("total").isNull() | F.col("start").isNull(), "Feed lacks valid totalResults/startIndex")))


def parse_feed(raw_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse result pages into the (pages, entries) tables that ``validation`` checks.

    An entry that breaks a rule puts its reason into its page's ``error``; pages with an error yield
    no entries.
    """
    parsed = parse_pages(raw_pages).withColumn("papers", F.transform("entry", _paper)).drop("entry")
    broken = F.filter(
        F.transform("papers", _entry_problem), lambda p: p.isNotNull())
    checked = parsed.withColumn("error", F.coalesce("error", F.get(broken, 0)))
    pages = checked.select("offset", "total", "start", F.size("papers").alias("n_papers"), "error")
    entries = (checked.where("error IS NULL")
               .select("offset", F.posexplode("papers").alias("position", "paper"))
               .select("offset", "position", "paper.*"))
    return pages, entries


def _entry_problem(paper: Column) -> Column:
    times_ok = is_iso_time(paper["published"]) & is_iso_time(paper["updated"])
    return (
        F.when(paper["id"].isNull(), "Invalid identifier")
        .when(paper["version"].isNull(), F.concat(F.lit("API omitted version for "), paper["id"]))
        .when((paper["title"] == "") | (paper["abstract"] == "") | (F.size(paper["categories"]) == 0),
              F.concat(F.lit("Incomplete metadata for "), paper["id"]))
        .when(~times_ok, F.concat(F.lit("Malformed timestamp for "), paper["id"])))
