"""File sinks on a file system that the driver and all executors share."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, functions as F

from quillspark.operators.ordering import with_running_total
from quillspark.session import ship_package

WRITE_BUFFER_BYTES = 4 << 20


def atomic_write(path: str | os.PathLike, content: str | bytes) -> None:
    """Create under another name, then rename: readers see the old or the new content, never a part."""
    final = Path(path)
    final.parent.mkdir(parents=True, exist_ok=True)
    draft = final.with_name(f".{final.name}.{uuid.uuid4().hex}")
    try:
        draft.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        draft.replace(final)
    finally:
        draft.unlink(missing_ok=True)


def write_json(path: str | os.PathLike, value) -> None:
    atomic_write(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def read_json(path: str | os.PathLike, default=None):
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else default


def write_files(files: DataFrame, root: str | os.PathLike) -> None:
    """Write each (path, content) row as one file, from the tasks. Repeating a task is harmless."""
    base = str(root)

    def write(rows: Iterable[Row]) -> None:
        for row in rows:
            atomic_write(Path(base, row.path), row.content)

    ship_package(files.sparkSession)
    files.select("path", "content").foreachPartition(write)


def write_joined(lines: DataFrame, order: list[Column], root: str | os.PathLike) -> None:
    """Write (path, text) lines as one file per path, in ``order`` (which ends in a unique key).

    A running total of byte lengths gives every line its offset, so all tasks write their own parts of
    the same file at once and no file passes through one task. The number of paths is small (one per
    topic or year); each is renamed into place when all its bytes are there.
    """
    base, token = str(root), f".tmp-{uuid.uuid4().hex}"

    def write(rows: Iterable[Row]) -> None:
        pending, path, start, size = [], None, 0, 0

        def flush() -> None:
            if pending:
                target = Path(base, path + token)
                target.parent.mkdir(parents=True, exist_ok=True)
                handle = os.open(target, os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    data, done = b"".join(pending), 0
                    while done < len(data):
                        done += os.pwrite(handle, data[done:], start + done)
                    os.fsync(handle)
                finally:
                    os.close(handle)

        for row in rows:
            data = row.text.encode("utf-8")
            begin = row.end - len(data)
            if row.path != path or begin != start + size or size > WRITE_BUFFER_BYTES:
                flush()
                pending, path, start, size = [], row.path, begin, 0
            pending.append(data)
            size += len(data)
        flush()

    ship_package(lines.sparkSession)
    sized = lines.withColumn("bytes", F.octet_length("text").cast("bigint"))
    placed = with_running_total(sized, ["path"], order, "bytes", "end")
    placed.select("path", "text", "end").foreachPartition(write)
    for row in lines.select("path").distinct().toLocalIterator():
        os.replace(Path(base, row.path + token), Path(base, row.path))
