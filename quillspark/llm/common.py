"""Helpers that the operators share: table access, and whole texts as numpy buffers in bounded pieces."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.session import gathered, materialise, ship_package

#: White space that ends a word: \x20 and \x09-\x0D, which is also what bytes.split() splits at.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Texts are worked on in pieces of about so many bytes (a longer text is a piece of its own).
PIECE_BYTES = 2_000_000
#: Rows in an Arrow batch; bounds what a Python worker holds when texts are long.
BATCH_ROWS = 1000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches of long texts small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a written table, and the shuffle files behind it given up. With ``rows``, it is written in as many tasks
    as a table of so many rows is worth.

    Spark deletes a shuffle's files once the driver has collected what refers to it, which a job of a few large
    steps would hardly ever do by itself; so its disk would hold the shuffles of all steps at once.
    """
    out = materialise(df if rows is None else gathered(df, rows))
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def words_of(text: Column) -> Column:
    """The words of a text; a NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def same_key(left: dict[str, str]) -> Column:
    """An equality of columns in which NULL equals NULL; left: names on one side to names on the other."""
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in left.items()))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; NULL counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def pieces(lengths: list[int], most: int = PIECE_BYTES) -> Iterator[slice]:
    """Consecutive slices of texts with about ``most`` bytes each."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n + 1
    if begin < len(lengths):
        yield slice(begin, len(lengths))


class Words:
    """The words of several texts in one buffer, each followed by one space.

    starts, ends: where each word lies in ``data``; first: index of each text's first word, and the end.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.first = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        self.data = b"".join(b" ".join(w) + b" " for w in split if w)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.ends = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends

    def __len__(self) -> int:
        return len(self.ends)

    def text(self, begin: int, end: int) -> bytes:
        """Words begin to end - 1, joined by one space."""
        return self.data[self.starts[begin]:self.ends[end - 1]]


_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    if len(_powers["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit argument."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one rolling sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])
