"""Rebuild every generated view of a library from its catalog."""

from __future__ import annotations

import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.config import search_url
from quillspark.functions.render import DEFAULT_COMMAND, LIBRARY_TITLE
from quillspark.operators import filters, postings, views
from quillspark.operators.routing import with_topics
from quillspark.plans.library import Library, now
from quillspark.session import materialise
from quillspark.sinks.files import atomic_write, write_files, write_joined, write_json

ENTRY_FILE = "ENTRY.md"
TABLE_FILE = "index/catalog.csv"
# How to go on from the entry page, with our own command.
ENTRY_GUIDE = (
    "1. `{command} search \"关键词\" --limit 12`：先看少量标题；也可以打开下方主题或年份目录。\n"
    "2. `{command} show ID`：阅读选中论文的原始摘要。\n"
    "3. `{command} fetch ID`，再 `{command} read ID --chunk 1`：按需阅读正文。")


def entry_page(counts: DataFrame, current: int, stored: int, last_sync: str | None, link: str,
               command: str = DEFAULT_COMMAND, rules=fixed.TOPIC_RULES) -> str:
    """The entry page: one line per non-empty topic and per year (a few dozen rows)."""
    rows = (counts.withColumn("heading", views.heading(rules)).orderBy(*views.entry_order(rules)).collect())
    first, second, end = fixed.ENTRY_COUNTS

    def section(prefix: str) -> list[str]:
        return [f"- [{r.heading}](index/{r.grp}/README.md)：{r.papers}{fixed.ENTRY_ITEM_UNIT}"
                for r in rows if r.grp.startswith(prefix)]
    return "\n".join([
        f"# {LIBRARY_TITLE}", "", f"{first}{current}{second}{stored}{end}",
        f"{fixed.ENTRY_LAST_SYNC}{last_sync or fixed.ENTRY_NEVER_SYNCED}。", "",
        ENTRY_GUIDE.format(command=command), "",
        fixed.ENTRY_TOPIC_HEAD, "", *section("topics/"), "",
        fixed.ENTRY_YEAR_HEAD, "", *section("years/"), "",
        f"[{fixed.ENTRY_SEARCH_LINK}]({link})", ""])


def _write_groups(papers: DataFrame, root: Path, size: int, rules) -> None:
    paged = materialise(views.pages(papers, size, rules))
    write_files(views.shards(paged), root)
    write_joined(views.menu_lines(views.menu(paged), size, rules), [F.col("line_no")], root)


def _write_table(papers: DataFrame, root: Path) -> None:
    header = papers.sparkSession.createDataFrame(
        [(0, "", "", "\ufeff" + ",".join(fixed.CSV_HEADER) + "\r\n")],
        "part int, published string, id string, text string")
    lines = header.unionByName(views.csv_lines(papers).withColumn("part", F.lit(1)))
    write_joined(lines.withColumn("path", F.lit(TABLE_FILE)), [F.col("part"), *views.newest_first()], root)


def build(library: Library, rules=fixed.TOPIC_RULES) -> int:
    """Write cards, shards, menus, the table export, the search index and, last, the entry page."""
    newest = library.store.latest()
    # Routing reads every text, so it runs once and all views share its result.
    routed = materialise(with_topics(library.store.papers(), rules))
    root, size = library.root, library.config.title_page_size
    # A new folder each time: searches that run now keep reading the index they started with.
    index = library.index_folder / uuid.uuid4().hex
    # The views do not depend on each other, so their jobs share the cluster at the same time.
    with ThreadPoolExecutor() as pool:
        jobs = [
            pool.submit(_write_groups, routed, root, size, rules),
            pool.submit(postings.write_index, routed, str(index), rules),
            pool.submit(write_files, views.cards(routed), root),
            pool.submit(_write_table, routed, root)]
        counts = views.group_counts(routed, rules)
        sizes = routed.agg(F.count(F.lit(1)).alias("stored"),
                           F.count_if(filters.is_current()).alias("current")).first()
        last_sync = newest.last_sync if newest else None
        entry = entry_page(counts, sizes.current, sizes.stored, last_sync, search_url(library.config),
                           rules=rules)
        for job in jobs:
            job.result()
    atomic_write(root / ENTRY_FILE, entry)
    write_json(library.state_path, {
        "catalog_sync": last_sync, "built_at": now(), "search_index": index.name})
    by_age = sorted(library.index_folder.iterdir(), key=lambda folder: folder.stat().st_mtime)
    for outdated in by_age[:-2]:
        shutil.rmtree(outdated, ignore_errors=True)
    return sizes.stored
