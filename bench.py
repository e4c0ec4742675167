"""Times the headline queries and a build of all views; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import functions as F

from quillspark.plans.build import build
from quillspark.plans.catalogue import QUERIES
from quillspark.plans.library import Library
from quillspark.session import local_session
from quillspark.sources.tables import papers_from_documents, table

HEADLINE = [
    "token_lists", "topic_route", "group_counts", "corpus_stats", "bm25_search", "bm25_topic",
    "bm25_indexed", "search_budget", "document_frequency", "total_order", "shard_pages", "menu_text",
    "cards", "csv_text", "show_budget", "merge_catalog", "merge_counts", "merge_repeats",
    "scan_validation", "feed_parse", "lookup_ids", "status_counts", "chunks", "manifest", "cache_valid",
    "read_chunk", "html_block_rows", "html_chunk_rows", "stream_merge"]


#: A query is run so often at most, and not again after so many seconds; its median counts.
RUNS, ENOUGH_SECONDS = 3, 12
LIBRARY_PAPERS = 1415


def build_seconds(spark, folder: str) -> float:
    """All views of a library of as many papers as the published figure is for; the faster of two builds."""
    with tempfile.TemporaryDirectory() as root:
        (Path(root) / "config.json").write_text(json.dumps({
            "terms": ["ontology"], "subjects": ["cs"], "page_size": 100, "api_delay_seconds": 3.1,
            "content_delay_seconds": 15.1, "timeout_seconds": 60, "retries": 3, "user_agent": "bench/1.0",
            "title_page_size": 40, "chunk_chars": 6000}))
        library = Library.open(spark, Path(root))
        papers = papers_from_documents(table(spark, folder, "documents")).limit(LIBRARY_PAPERS)
        library.store.change(lambda _: papers.withColumns({"first_seen": F.lit("t"), "last_seen": F.lit("t")}), last_sync="t")
        return min(timed(lambda: build(library)) for _ in range(2))


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the Python workers and the code generator before the clock runs.
    QUERIES["html_block_rows"](spark, folder).limit(1).count()
    seconds = {}
    for name in HEADLINE:
        runs = []
        while len(runs) < RUNS and sum(runs) < ENOUGH_SECONDS:
            runs.append(timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()))
        seconds[name] = median(runs)
    seconds["build_1415_papers"] = build_seconds(spark, folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
