"""Filter interaction audit: one byte transducer measures a text, and what each filter removes is counted in any order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import mixed, pieces, python_ready, span_hashes, stored, text_bytes

#: Classes of bytes. The transducer reads UTF-8: LEAD opens a code point of several bytes, INNER continues it.
GAP, CAPITAL, SYMBOL, PLAIN, LEAD, INNER = range(6)
CLASSES = np.full(256, PLAIN, np.uint8)
CLASSES[[32, *range(9, 14)]] = GAP
CLASSES[ord("A"):ord("Z") + 1] = CAPITAL
CLASSES[list(b"#$%&*|")] = SYMBOL
CLASSES[0xC0:] = LEAD
CLASSES[0x80:0xC0] = INNER
#: States, and what a step puts out: bits that the pass adds up or takes places from.
OUTSIDE, INSIDE = range(2)
OPENS, CLOSES, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """NEXT and OUTPUT by [state, class]."""
    state, kind = np.ogrid[:2, :6]
    after = np.where(kind == GAP, OUTSIDE, INSIDE) + 0 * state
    output = (np.where((state == OUTSIDE) & (after == INSIDE), OPENS, 0)
              | np.where((state == INSIDE) & (after == OUTSIDE), CLOSES, 0)
              | np.where(kind == CAPITAL, IS_CAPITAL, 0) | np.where(kind != INNER, IS_POINT, 0)
              | np.where(kind == SYMBOL, IS_SYMBOL, 0))
    return after.astype(np.uint8), output.astype(np.uint8)


NEXT, OUTPUT = _tables()
MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def transduced(data: np.ndarray) -> np.ndarray:
    """The output of each byte; the state before the first is OUTSIDE. Both rows of NEXT are alike, so the state
    before a byte is known from the class of the byte before, and the pass needs no loop."""
    kind = CLASSES[data]
    before = np.empty_like(kind)
    before[:1] = OUTSIDE
    before[1:] = NEXT[OUTSIDE][kind[:-1]]
    return OUTPUT.ravel()[before * np.uint8(OUTPUT.shape[1]) + kind]


def first_seen(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each span is the first of its owner with these bytes that the table holds, so that of equal spans
    exactly one is marked.

    An open hash table of span numbers: all pending spans look at their slot at the same time, empty slots are taken,
    and a span that meets another stays there only if owner, length and bytes are equal; else it tries the next slot.
    ``data`` goes on for eight bytes behind the last span.
    """
    n = len(starts)
    first = np.zeros(n, bool)
    if not n:
        return first
    size = 1 << int(2 * n).bit_length()
    slot = (mixed(span_hashes(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            & np.uint64(size - 1)).astype(np.int64)
    length = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    table = np.full(size, -1, np.int64)
    pending = np.arange(n)
    while len(pending):
        at = slot[pending]
        free = table[at] < 0
        table[at[free]] = pending[free]
        held = table[at]
        first[pending[held == pending]] = True
        equal = (owner[held] == owner[pending]) & (length[held] == length[pending])
        rest, offset = np.flatnonzero(equal & (held != pending)), 0
        while len(rest):
            own, other = pending[rest], held[rest]
            left = np.minimum(length[own] - offset, 8).astype(np.uint64)
            mask = ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left)
            differ = ((eight[starts[own] + offset] ^ eight[starts[other] + offset]) & mask) != 0
            equal[rest[differ]] = False
            offset += 8
            rest = rest[~differ & (length[own] > offset)]
        pending = pending[~equal]
        slot[pending] = (slot[pending] + 1) & (size - 1)
    return first


def measures(texts: list[bytes]) -> np.ndarray:
    """A row of MEASURES for each text."""
    if not texts:
        return np.zeros((0, len(MEASURES)), np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    out = transduced(data[:len(data) - 8])
    starts, ends = np.flatnonzero(out & OPENS), np.flatnonzero(out & CLOSES)
    owner = np.searchsorted(begin, starts, "right") - 1
    new = first_seen(data, starts, ends, owner)
    count = lambda bit: np.add.reduceat((out & bit) != 0, begin, dtype=np.int64)
    return np.stack([np.bincount(owner, minlength=len(texts)), np.bincount(owner[new], minlength=len(texts)),
                     count(IS_CAPITAL), count(IS_POINT) - 1, count(IS_SYMBOL)], axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(2))
        for cut in pieces([len(t) for t in texts]):
            own = batch.slice(cut.start, cut.stop - cut.start)
            digests = [hashlib.sha256(t).digest() for t in texts[cut]]
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(digests, pa.binary()),
                 *[pa.array(np.ascontiguousarray(m)) for m in measures(texts[cut]).T]],
                names=["key", "part", "digest", *MEASURES])


def measured(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """key, part (a string, '' for NULL), digest (SHA-256 of the text) and MEASURES of every whole text. NULL counts
    as the empty text. Words end at \\x20 and \\x09-\\x0D and are compared as they are."""
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).alias("text"))
    counts = ", ".join(f"{m} bigint" for m in MEASURES)
    return rows.mapInArrow(_measure, f"key {kind}, part string, digest binary, {counts}")


#: Conditions under which a text fails, by letter; the filter after them, E, fails what an earlier key's text equals.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_points",
    "D": "n_symbols > 0",
}
COPY = "E"


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text",
             conditions: dict[str, str] = CONDITIONS) -> DataFrame:
    """part, mask, documents, good, toxic: how many documents fail which filters.

    mask has one bit for each filter, in the order of ``conditions`` with COPY last. A row fails COPY if a smaller key
    has an equal text; rows without a key neither do nor make others do, and rows that repeat key and text are
    alike. good and toxic count those with a label row that says 1.
    """
    rows = stored(measured(docs, key, part, text).select("key", "part", "digest", sum(
        (F.expr(c).cast("int") * (1 << i) for i, c in enumerate(conditions.values())), F.lit(0)).alias("mask")))
    marks = labels.groupBy(F.col(key).alias("_k")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"_{c}") for c in ("quality", "toxic")])
    # Rows of one text are spread by their keys, so no group of copies meets in one task.
    counted = rows.join(marks, F.col("key") == F.col("_k"), "left").groupBy(
        "digest", "key", "part", "mask", "_quality", "_toxic").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.groupBy(F.col("digest").alias("_d")).agg(F.min("key").alias("_first"))
    judged = counted.join(firsts, (F.col("digest") == F.col("_d")) & (F.col("key") == F.col("_first")), "left")
    copy = (F.col("key").isNotNull() & F.col("_first").isNull()).cast("int") * (1 << len(conditions))
    return judged.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.sum("n").alias("documents"), F.sum(F.when(F.col("_quality") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def _total(cells: Column, wanted, value: str) -> Column:
    return F.aggregate(F.filter(cells, wanted), F.lit(0).cast("bigint"), lambda total, c: total + c[value])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text",
          conditions: dict[str, str] = CONDITIONS) -> DataFrame:
    """One row for each part, filter_order and step: what the filter of that step does after those before it.

    kept, removed, redundant (fails, removed earlier), unique_fails (fails this filter only), good_lost and toxic_lost
    (removed here, by label) and shapley: what the filter removes, summed over all orders. All follow from the number
    of documents for each set of failed filters, so the texts are read once whatever the number of orders. NULL
    parts and texts count as empty ones; an empty table gives no rows; other columns do not matter.
    """
    letters = [*conditions, COPY]
    table = stored(failures(docs, labels, key, part, text, conditions))
    cells = table.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("cells"))
    orders = list(permutations(letters))
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [{"filter_order": "".join(order), "step": i + 1, "own": bit[letter], "before": sum(map(bit.get, order[:i]))}
             for order in orders for i, letter in enumerate(order)]
    fields = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    rows = cells.select("part", "cells", F.inline(F.from_json(F.lit(json.dumps(steps)), fields)))
    cells, own, before = F.col("cells"), F.col("own"), F.col("before")

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(own) != 0

    def left(c: Column) -> Column:
        return c["mask"].bitwiseAND(before) == 0

    def here(c: Column) -> Column:
        return fails(c) & left(c)

    # Of the orders of all filters, the one of a document's failed filters that comes first removes it: each as often.
    shares = F.transform(F.filter(cells, fails), lambda c: F.struct(
        (c["documents"] * len(orders) / F.bit_count(c["mask"])).cast("bigint").alias("orders")))
    return rows.select(
        "part", "filter_order", "step",
        _total(cells, lambda c: ~fails(c) & left(c), "documents").alias("kept"),
        _total(cells, here, "documents").alias("removed"),
        _total(cells, lambda c: fails(c) & ~left(c), "documents").alias("redundant"),
        _total(cells, lambda c: c["mask"] == own, "documents").alias("unique_fails"),
        _total(cells, here, "good").alias("good_lost"), _total(cells, here, "toxic").alias("toxic_lost"),
        _total(shares, lambda c: F.lit(True), "orders").alias("shapley"))
