"""Versioned storage of the catalog.

Every commit writes a new generation folder and then adds one row to the commit log; a generation without its row does
not exist for readers. The row is a file named by its generation that appears complete or not at all, and of several
writers that built on the same generation only one gets its row in; the others merge again. The generation before stays
as the backup.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from quillspark.operators.merge import COUNTED_STATES
from quillspark.schema import CATALOG
from quillspark.sinks.commit_log import put_if_absent

REPORT = T.StructType(
    [T.StructField(name, T.LongType()) for name in (*COUNTED_STATES, "total_results", "total_stored")]
    + [T.StructField(name, T.StringType()) for name in (
        "started_at", "completed_at", "query", "source", "web_search_url")])
COMMIT = T.StructType([
    T.StructField("generation", T.LongType(), False),
    T.StructField("schema_version", T.IntegerType(), False),
    T.StructField("query", T.StringType()),
    T.StructField("last_sync", T.StringType()),
    T.StructField("last_report", REPORT),
    T.StructField("stream", T.StringType()),
    T.StructField("batch", T.LongType()),
    T.StructField("folder", T.StringType()),
])
SCHEMA_VERSION = 1
#: How often a change is merged again because another writer was faster.
MOST_TRIES = 20


class CommitConflict(RuntimeError):
    """Another writer has committed this generation."""


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = CATALOG):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _folder(self, commit: Row) -> str:
        return f"{self.root}/generations/{commit.folder or f'{commit.generation:08d}'}"

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.root}/commits")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def latest(self) -> Row | None:
        """The newest commit, or None for a catalog that was never written."""
        return self.commits().orderBy(F.desc("generation")).first()

    def generation(self) -> int:
        newest = self.latest()
        return newest.generation if newest else 0

    def papers(self, generation: int | None = None) -> DataFrame:
        """One generation (the newest by default); no rows when there is none."""
        found = self.commits()
        if generation is not None:
            found = found.where(F.col("generation") == generation)
        wanted = found.orderBy(F.desc("generation")).first()
        return self.spark.read.parquet(self._folder(wanted)) if wanted else self.spark.createDataFrame([], self.schema)

    def previous(self) -> DataFrame:
        return self.papers(max(0, self.generation() - 1))

    def runs(self) -> DataFrame:
        """Every run report, oldest first."""
        return self.commits().where("last_report IS NOT NULL").orderBy("generation").select("last_report.*")

    def write(self, papers: DataFrame, generation: int) -> str:
        """Write a generation that is not visible yet; gives its folder's name, which no other writer has."""
        name = f"{generation:08d}-{uuid.uuid4().hex}"
        papers.write.parquet(f"{self.root}/generations/{name}")
        return name

    def prune(self, keep: int = 2) -> None:
        """Delete generations older than the newest ``keep``: the catalog and its backup."""
        oldest_kept = self.generation() - keep + 1
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generations")
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in store.listStatus(root):  # the folders that still exist, not every commit ever made
            if int(found.getPath().getName().split("-")[0]) < oldest_kept:
                store.delete(found.getPath(), True)

    def last_batch(self, stream: str) -> int:
        """The highest micro-batch of a streaming query that the catalog holds; -1 when there is none."""
        newest = self.commits().where(F.col("stream") == stream).agg(F.max("batch")).first()[0]
        return -1 if newest is None else newest

    def commit(self, generation: int, folder: str, query: str | None = None, last_sync: str | None = None,
               report: dict | None = None, stream: str | None = None, batch: int | None = None) -> None:
        """Make a written generation the catalog; raises CommitConflict if this generation has a row already."""
        row = {"generation": generation, "schema_version": SCHEMA_VERSION, "query": query, "last_sync": last_sync,
               "last_report": None if report is None else {name: report.get(name) for name in REPORT.names},
               "stream": stream, "batch": batch, "folder": folder}
        content = json.dumps(row, ensure_ascii=False).encode() + b"\n"
        if not put_if_absent(self.spark, f"{self.root}/commits", f"{generation:08d}.json", content):
            raise CommitConflict(f"generation {generation} has been committed by another writer")

    def change(self, build: Callable[[DataFrame], DataFrame],
               describe: Callable[[DataFrame], dict] = lambda written: {}, **row) -> dict:
        """Build a generation from the newest one and commit it, again if another writer was faster, so that no commit
        is lost. ``describe`` gives a part of the commit row from what was written; the whole row is returned."""
        for _ in range(MOST_TRIES):
            newest = self.latest()
            target = newest.generation + 1 if newest else 1
            folder = self.write(build(self.papers(newest.generation if newest else None)), target)
            told = {**row, **describe(self.spark.read.parquet(f"{self.root}/generations/{folder}"))}
            try:
                self.commit(target, folder, **told)
            except CommitConflict:
                continue
            self.prune()
            return told
        raise CommitConflict(f"other writers were faster {MOST_TRIES} times")
