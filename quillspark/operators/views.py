"""Topic and year views of the catalog: shards, menus, entry page, cards and the table export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import render
from quillspark.functions.ids import file_key
from quillspark.functions.text import padded
from quillspark.operators.filters import current
from quillspark.operators.ordering import with_position
from quillspark.operators.routing import with_topics
from quillspark.session import materialise


def newest_first() -> list[Column]:
    return [F.desc("published"), F.desc("id")]


def group_members(papers: DataFrame, rules=fixed.TOPIC_RULES) -> DataFrame:
    """Current papers once per topic and once per year, with ``grp`` = 'topics/x' or 'years/yyyy'."""
    active = with_topics(current(papers), rules)
    groups = F.concat(
        F.transform("topics", lambda t: F.concat(F.lit("topics/"), t)),
        F.array(F.concat(F.lit("years/"), F.substring("year_month", 1, 4))))
    return active.select(
        F.explode(groups).alias("grp"), "id", "version", "title", "year_month", "published")


def group_counts(papers: DataFrame, rules=fixed.TOPIC_RULES) -> DataFrame:
    """Papers per non-empty topic and per year."""
    return group_members(papers, rules).groupBy("grp").agg(F.count(F.lit(1)).alias("papers"))


def entry_order(rules=fixed.TOPIC_RULES) -> list[Column]:
    """Topics in rule order, then years from the newest."""
    ordinal = F.array_position(F.lit([f"topics/{r[0]}" for r in rules]), F.col("grp"))
    is_topic = F.col("grp").startswith("topics/")
    return [F.desc(is_topic), F.when(is_topic, ordinal).asc(), F.desc("grp")]


def heading(rules=fixed.TOPIC_RULES) -> Column:
    titles = F.create_map(*[F.lit(x) for r in rules for x in (f"topics/{r[0]}", r[1])])
    return F.coalesce(F.try_element_at(titles, F.col("grp")), F.split("grp", "/")[1])


def pages(papers: DataFrame, page_size: int, rules=fixed.TOPIC_RULES) -> DataFrame:
    """One row per shard page: its rows in order (at most ``page_size``) and its month range.

    Positions come from a range sort, so a topic or year of any size is spread over all tasks.
    """
    # Stored first: a range sort reads its input twice, and routing is the expensive part.
    members = materialise(group_members(papers, rules))
    placed = with_position(members, ["grp"], newest_first())
    page = F.floor(F.col("position") / page_size) + 1
    line = F.struct("position", render.shard_row().alias("line"))
    grouped = placed.groupBy("grp", page.alias("page")).agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.min_by("year_month", "position").alias("first_month"),
        F.max_by("year_month", "position").alias("last_month"))
    return grouped.withColumn("lines", F.col("lines.line")).withColumn("heading", heading(rules))


def shards(paged: DataFrame) -> DataFrame:
    """(path, content) of every shard file."""
    content = F.concat(
        F.lit("# "), F.col("heading"), F.lit(" / "), F.col("page").cast("string"), F.lit("\n\n"),
        F.lit(fixed.SHARD_TABLE_HEAD), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n"))
    path = F.concat(F.lit("index/"), F.col("grp"), F.lit("/"), padded(F.col("page"), 3), F.lit(".md"))
    return paged.select(path.alias("path"), content.alias("content"))


def menu(paged: DataFrame) -> DataFrame:
    """One row per page of a group menu."""
    return paged.select("grp", "page", F.size("lines").alias("papers"), "first_month", "last_month")


def menu_lines(menu_rows: DataFrame, page_size: int, rules=fixed.TOPIC_RULES) -> DataFrame:
    """(path, line_no, text) of the menu files: the head is line 0, then one line per page."""
    number, link, months, to = fixed.MENU_PAGE_LINE
    path = F.concat(F.lit("index/"), F.col("grp"), F.lit("/README.md"))
    page = F.col("page").cast("string")
    body = menu_rows.select(path.alias("path"), F.col("page").alias("line_no"), F.concat(
        F.lit(number), page, F.lit(link), padded(F.col("page"), 3), F.lit(months),
        F.col("first_month"), F.lit(to), F.col("last_month"), F.lit("\n")).alias("text"))
    totals = menu_rows.groupBy("grp").agg(F.sum("papers").alias("papers"))
    head = totals.select(path.alias("path"), F.lit(0).cast("bigint").alias("line_no"), F.concat(
        F.lit("# "), heading(rules), F.lit("\n\n"), F.col("papers").cast("string"),
        F.lit(fixed.MENU_COUNT_LINE[0] + str(page_size) + fixed.MENU_COUNT_LINE[1] + "\n\n"),
    ).alias("text"))
    return head.unionByName(body)


def cards(papers: DataFrame, rules=fixed.TOPIC_RULES,
          command: str = render.DEFAULT_COMMAND, keep: Sequence[str] = ()) -> DataFrame:
    """(id, path, content) of every card, including papers missing from the latest scan, and the columns to keep."""
    return with_topics(papers, rules).select(
        *keep, "id", F.concat(F.lit("cards/"), file_key(F.col("id")), F.lit(".md")).alias("path"),
        render.card(command).alias("content"))


def export_rows(papers: DataFrame) -> DataFrame:
    """The table export, one row per stored paper, every value as text."""
    values = {
        "arxiv_id": F.col("id"), "version": F.col("version").cast("string"),
        "year_month": F.col("year_month"), "title": F.col("title"), "abstract": F.col("abstract"),
        "published": F.col("published"), "updated": F.col("updated"),
        "categories": F.array_join("categories", ";"), "url": F.col("abs_url"),
        "in_latest_search": render.python_bool(F.coalesce("in_latest_search", F.lit(True)))}
    return papers.select(*[values[name].alias(name) for name in fixed.CSV_HEADER])


def csv_lines(papers: DataFrame) -> DataFrame:
    """(published, id, text): the export as CSV records with minimal quoting and CRLF ends."""
    def field(name: str) -> Column:
        value = F.col(name)
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[,"\r\n]'), quoted).otherwise(value)
    record = F.concat(F.concat_ws(",", *[field(n) for n in fixed.CSV_HEADER]), F.lit("\r\n"))
    return export_rows(papers).select("published", F.col("arxiv_id").alias("id"), record.alias("text"))


def status_counts(papers: DataFrame, cached: DataFrame) -> DataFrame:
    """Stored, current and cached papers. ``cached`` holds (id, version) of existing manifests."""
    manifests = cached.select("id", "version").distinct().withColumn("hit", F.lit(True))
    flagged = papers.select("id", "version", "in_latest_search").join(
        manifests, ["id", "version"], "left")
    is_current = F.coalesce("in_latest_search", F.lit(True))
    return flagged.agg(
        F.count(F.lit(1)).alias("papers_stored"),
        F.count_if(is_current).alias("papers_in_latest_search"),
        F.count_if(is_current & F.coalesce("hit", F.lit(False))).alias("current_fulltexts_cached"))
