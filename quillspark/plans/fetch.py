"""Download, extract, cut and cache full texts.

Downloads are serial and throttled on the driver, as the source requires. Extraction, cutting, hashing
and the file writes run as Spark jobs over all landed originals at once.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from itertools import islice
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.chunking import chunk_blocks
from quillspark.functions.html import html_blocks
from quillspark.functions.ids import parse_id_text
from quillspark.functions.pdf import pdf_page_blocks
from quillspark.operators import filters, fulltext, lookup
from quillspark.plans.library import Library, now
from quillspark.session import materialise, ship_package
from quillspark.sinks.files import atomic_write, write_files
from quillspark.sources import library as files
from quillspark.sources.connector import FetchError

Progress = Callable[[str], None]
# Downloads between two Spark runs: at 15 seconds each, an interruption costs a few minutes of work.
BATCH = 20


class Paper(NamedTuple):
    id: str
    version: int
    title: str

    @property
    def name(self) -> str:
        return f"{self.id}v{self.version}"

    def folder(self, root: Path) -> Path:
        key = self.id.replace("/", "_")
        return root / "papers" / key / f"{key}v{self.version}"


class Outcome(NamedTuple):
    cached: list[str]
    failures: dict[str, str]


def cache_states(library: Library, keys: list[str] | None = None) -> DataFrame:
    """Cache validity of some or all papers; only the folders of ``keys`` are read."""
    spark, root = library.spark, str(library.root)
    rows = files.manifests(spark, root, keys)
    return fulltext.cache_state(rows, files.stored_files(spark, root, rows, keys))


def _landing_path(paper: Paper, root: Path, kind: str) -> Path:
    """A saved original, or where a fresh download waits until its extraction succeeded."""
    kept = paper.folder(root) / f"original.{kind}"
    return kept if kept.exists() else paper.folder(root) / f".incoming.{kind}"


def _download(library: Library, client, papers: Iterable[Paper], kind: str,
              failures: dict[str, FetchError | ValueError], landed: list[tuple]) -> FetchError | None:
    """Land the originals that are not there yet. Returns the refusal that has to stop all requests."""
    base = fixed.HTML_URL if kind == "html" else fixed.PDF_URL
    for paper in papers:
        path = _landing_path(paper, library.root, kind)
        source = base + paper.name
        if not path.exists():
            try:
                body = client.get(source, content=True)
                if kind == "pdf" and not body.startswith(b"%PDF-"):
                    raise ValueError("The response is not a PDF; nothing was cached")
            except (FetchError, ValueError) as problem:
                failures[paper.id] = problem
                if getattr(problem, "status", None) in fixed.STOP_STATUSES:
                    return problem
                continue
            # A PDF is kept even when its text cannot be extracted.
            path = path if kind == "html" else paper.folder(library.root) / "original.pdf"
            atomic_write(path, body)
        landed.append((*paper, source, kind, str(path)))
    return None


LANDED = "id string, version int, title string, source_url string, format string, landed string"


def _extract(library: Library, landed: list[tuple], notes: dict[str, str], pdf_udf: Column) -> DataFrame:
    """documents (see ``operators.fulltext``) with an ``error`` for originals without usable text."""
    spark = library.spark
    ship_package(spark)
    rows = [(*row, [notes[row[0]]] if row[0] in notes else []) for row in landed]
    listed = spark.createDataFrame(rows, LANDED + ", earlier array<string>")
    raw = files.originals(spark, listed)
    if landed and landed[0][4] == "pdf":
        found = raw.withColumn("r", pdf_udf("raw")).withColumn("notes", F.col("r.warnings"))
    else:
        found = raw.withColumn("r", html_blocks("raw")).withColumn(
            "notes", F.array(F.lit(fixed.HTML_NOTE)))
    return found.select(
        "id", "version", "title", "source_url", "format", "landed", F.col("r.error").alias("error"),
        F.concat("earlier", F.coalesce("notes", F.array().cast("array<string>"))).alias("warnings"),
        F.sha2("raw", 256).alias("source_sha256"),
        chunk_blocks(F.col("r.blocks"), library.config.chunk_chars).alias("chunks"))


def _store(library: Library, documents: DataFrame) -> None:
    """Write chunk files, then contents pages, then manifests: a manifest promises the rest."""
    base = fulltext.folder(F.col("id"), F.col("version"))
    chunk_rows = fulltext.chunk_files(documents)
    write_files(chunk_rows.select(
        F.concat(base, F.lit("/"), F.col("path")).alias("path"), F.col("body").alias("content")), library.root)
    rows = materialise(fulltext.manifests(documents, now()))
    write_files(rows.select(
        F.concat(base, F.lit("/CONTENTS.md")).alias("path"), F.col("contents").alias("content")), library.root)
    write_files(rows.select(
        F.concat(base, F.lit("/manifest.json")).alias("path"),
        F.concat(F.to_json("manifest", {"pretty": "true"}), F.lit("\n")).alias("content")), library.root)


def _process(library: Library, landed: list[tuple], notes: dict[str, str], outcome: Outcome,
             pdf_udf=pdf_page_blocks) -> dict[str, str]:
    """Extract and cache landed originals; returns the reasons of those without usable text."""
    if not landed:
        return {}
    documents = materialise(_extract(library, landed, notes, pdf_udf))
    good = documents.where("error IS NULL AND size(chunks) > 0")
    _store(library, good)
    problems = {}
    # One row per download of this run, which the serial throttle keeps short.
    for row in documents.select("id", "landed", "error", F.size("chunks").alias("n")).toLocalIterator():
        path = Path(row.landed)
        if row.error is not None or row.n <= 0:
            problems[row.id] = row.error or "No text was extracted"
            if path.name.startswith(".incoming"):
                path.unlink()
        else:
            outcome.cached.append(row.id)
            if path.name.startswith(".incoming"):
                os.replace(path, path.with_name("original" + path.suffix))
    return problems


def _fetch_batch(library: Library, client, papers: list[Paper], preferred: str, outcome: Outcome,
                 pdf_udf) -> FetchError | None:
    """One batch: HTML first, then PDF for what HTML could not give. Returns a refusal, if any."""
    notes: dict[str, str] = {}
    refusal, for_pdf = None, papers if preferred == "pdf" else []
    if preferred in ("auto", "html"):
        failures: dict[str, FetchError | ValueError] = {}
        landed: list[tuple] = []
        refusal = _download(library, client, papers, "html", failures, landed)
        unusable = _process(library, landed, notes, outcome)
        for paper in papers:
            problem = failures.get(paper.id)
            reason = unusable.get(paper.id) or (str(problem) if problem else None)
            if reason is None:
                continue
            absent = getattr(problem, "status", None) in fixed.MISSING_STATUSES
            if preferred == "auto" and (paper.id in unusable or absent):
                notes[paper.id] = f"HTML unavailable/unusable; PDF fallback used ({reason})."
                for_pdf.append(paper)
            else:
                outcome.failures[paper.id] = reason
    if for_pdf and refusal is None:
        failures, landed = {}, []
        refusal = _download(library, client, for_pdf, "pdf", failures, landed)
        unusable = _process(library, landed, notes, outcome, pdf_udf)
        outcome.failures.update({i: str(p) for i, p in failures.items()}, **unusable)
    return refusal


def fetch(library: Library, client, papers: DataFrame, preferred: str = "auto",
          progress: Progress = print, pdf_udf=pdf_page_blocks, ids: list[str] | None = None) -> Outcome:
    """Cache the full texts of catalog rows, batch by batch.

    When a user named the papers, ``ids`` keeps the cache check to their folders. A failed paper does not
    stop the others. An access denial or rate limit stops all further requests,
    after what has landed was stored.
    """
    missing = materialise(
        fulltext.to_fetch(papers.select("id", "version", "title"), cache_states(library, _keys(ids))))
    waiting = (Paper(*row) for row in missing.orderBy("id").toLocalIterator())
    outcome = Outcome([], {})
    while batch := list(islice(waiting, BATCH)):
        refusal = _fetch_batch(library, client, batch, preferred, outcome, pdf_udf)
        progress(f"Cached {len(outcome.cached)}, failed {len(outcome.failures)}")
        if refusal is not None:
            raise refusal
    return outcome


def _keys(ids: list[str] | None) -> list[str] | None:
    return [parse_id_text(value)[0].replace("/", "_") for value in ids] if ids else None


def choose(library: Library, ids: list[str], everything: bool) -> DataFrame:
    """The current papers, or the ones a user named; raises for a name that does not resolve."""
    papers = library.store.papers()
    if everything:
        return filters.current(papers)
    asked = [parse_id_text(value) for value in ids]
    chosen = papers.where(F.col("id").isin([base for base, _ in asked]))
    stored = {row.id: row.version for row in chosen.select("id", "version").collect()}
    for base, version in asked:
        if base not in stored:
            raise ValueError(f"{base} is not in this catalog. Run update first.")
        if version and version != stored[base]:
            raise ValueError(f"Catalog describes v{stored[base]}; another version was asked for")
    return chosen


def read(library: Library, value: str, chunk: int | None = None, max_chars: int = 8000) -> str:
    """The contents page or one verified chunk of the current version of a paper, within the budget."""
    spark, root = library.spark, str(library.root)
    paper = lookup.get_paper(library.store.papers(), value).select("id", "version").first()
    keys = _keys([paper.id])
    rows = files.manifests(spark, root, keys).where(
        (F.col("id") == paper.id) & (F.col("version") == paper.version))
    if chunk is None:
        page = rows.select(fulltext.truncated(F.col("contents"), max_chars).alias("text")).first()
        if page is None:
            raise ValueError(f"The current version is not cached; fetch {paper.id} first")
        return page.text
    wanted = spark.createDataFrame([(paper.id, paper.version, chunk)], "id string, version int, chunk_no int")
    answer = fulltext.read_chunks(rows, files.stored_files(spark, root, rows, keys), wanted, max_chars).first()
    if answer.problem:
        raise ValueError(f"{answer.problem} ({paper.id})")
    return answer.text

