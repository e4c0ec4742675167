"""One library folder: its settings, its catalog and the single-writer lock."""

from __future__ import annotations

import contextlib
import datetime as dt
import fcntl
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from quillspark.config import Config, load_config
from quillspark.sinks.catalog import CatalogStore


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


@dataclass
class Library:
    spark: SparkSession
    root: Path
    config: Config

    @classmethod
    def open(cls, spark: SparkSession, root: Path) -> Library:
        root = Path(root).resolve()
        return cls(spark, root, load_config(root))

    @property
    def store(self) -> CatalogStore:
        return CatalogStore(self.spark, f"{self.root}/data/catalog")

    @property
    def progress_path(self) -> Path:
        return self.root / "data/sync-progress.json"

    @property
    def state_path(self) -> Path:
        return self.root / "data/index-state.json"

    @property
    def index_folder(self) -> Path:
        return self.root / "data/search-index"

    def scan_folder(self, started_at: str) -> Path:
        return self.root / "data/raw" / started_at.replace(":", "-")


@contextlib.contextmanager
def writer_lock(root: Path):
    """One writer per library; the operating system frees the lock when the process ends."""
    path = Path(root) / "data/.writer.lock"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as stream:
        try:
            fcntl.flock(stream, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as problem:
            raise RuntimeError("Another update, fetch or reindex is running in this library") from problem
        try:
            yield
        finally:
            fcntl.flock(stream, fcntl.LOCK_UN)
