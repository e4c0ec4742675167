"""Substring dedup by super-k-mers: runs of windows that share a minimiser travel as one packed string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import (
    Words, mixed, pieces, python_ready, same_key, span_hashes, stored, text_bytes)

WINDOW, MINIMISER = 35, 6
#: A minimiser with more runs than this is dealt by single windows; the results are the same.
HOT_RUNS = 5_000
_BLOCK = 20_000


def _word_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x100000001B3) + hashes[j:len(hashes) - size + 1 + j]
    return mixed(total)


def runs_of(words: Words, window: int, minimiser: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of consecutive windows of one text whose minimiser is the same occurrence.

    The minimiser of a window is its leftmost group of ``minimiser`` words with the least hash, so equal
    windows have it at the same place in them, and two equal windows are never in one run.
    Returns for each run: its text's index, its first window (as a word index in the text), its windows,
    and the hash of its minimiser.
    """
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    if not len(text):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    kept = np.maximum(counts - window + 1, 0)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(kept) - kept, kept)
    begin = words.first[text] + inside
    grams = _word_grams(span_hashes(words.bytes, words.starts, words.ends), minimiser)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - minimiser + 1)
    least = np.concatenate([begin[i:i + _BLOCK] + view[begin[i:i + _BLOCK]].argmin(1)
                            for i in range(0, len(begin), _BLOCK)])
    new = np.ones(len(text), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(text)))
    return text[at], inside[at], length, grams[least[at]].view(np.int64)


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _list_runs(window: int, minimiser: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for cut in pieces([len(t) for t in texts]):
                text, first, n, key = runs_of(Words(texts[cut]), window, minimiser)
                own = batch.slice(cut.start, cut.stop - cut.start)
                rows = pa.array(text)
                schema = pa.schema([("minimiser", pa.int64()), ("_id", own.column(0).type),
                                    ("_hash", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
                yield _table(schema, key, own.column(0).take(rows), own.column(1).take(rows),
                             first.astype(np.int32), n.astype(np.int32))
    return emit


def _pack_runs(window: int):
    """Cuts the packed strings of a text's listed runs."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            lists = batch.column(3)
            for cut in pieces([len(t) for t in texts], 500_000):
                rows, runs, packed = [], [], []
                for i in range(cut.start, cut.stop):
                    words = Words([texts[i]])
                    own = lists[i].as_py()
                    rows += [i] * len(own)
                    runs += own
                    packed += [words.text(r["first"], r["first"] + r["n"] + window - 1) for r in own]
                at = pa.array(rows, pa.int64())
                schema = pa.schema([("_id", batch.column(0).type), ("_hash", pa.int64()), ("first", pa.int32()),
                                    ("hot", pa.bool_()), ("bucket", pa.int64()), ("packed", pa.binary())])
                yield _table(schema, batch.column(0).take(at), batch.column(1).take(at), [r["first"] for r in runs],
                             [r["hot"] for r in runs], [r["minimiser"] for r in runs], packed)
    return emit


_WINDOWS = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("window", pa.binary()),
                      ("copies", pa.int64())])


def _list_windows(window: int):
    """The windows of each distinct string, with the string's copies; a window travels as its 128-bit hash."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, packed, copies in zip(*(c.to_pylist() for c in batch.columns)):
                words, digest = Words([packed]), hashlib.md5(packed).digest()
                out += [(bucket, digest, j, hashlib.blake2b(words.text(j, j + window), digest_size=16).digest(), copies)
                        for j in range(len(words) - window + 1)]
            yield _table(_WINDOWS, *([r[i] for r in out] for i in range(5)))
    return emit


def _hot_spans(strings: DataFrame, window: int) -> DataFrame:
    """What _count_windows gives, for the strings (bucket, packed, copies) of minimisers with very many runs: their
    windows are counted by their own hashes, so no such minimiser fills one task. A string has few windows, whose
    ranges are put together again before they meet the texts."""
    rows = stored(strings.mapInArrow(_list_windows(window),
                                     "bucket bigint, digest binary, at int, window binary, copies bigint"))
    often = rows.groupBy(F.col("window").alias("_w")).agg(F.sum("copies").alias("_n")).filter("_n > 1")
    marked = rows.join(often, F.col("window") == F.col("_w")).groupBy("bucket", "digest").agg(
        F.sort_array(F.collect_set("at")).alias("ats"))
    starts = F.filter("ats", lambda a: ~F.array_contains("ats", a - 1))
    ends = F.filter("ats", lambda a: ~F.array_contains("ats", a + 1))
    return marked.select("bucket", "digest", F.zip_with(starts, ends, lambda a, b: F.struct(
        a.alias("from"), (b + window).alias("to"))).alias("spans"))


def repeated_words(strings: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """For the distinct packed strings of one bucket, each with its copies: the word spans [from, to) that
    repeated windows cover. Windows are sorted; equal neighbours are repeated, as are those of a copied string."""
    marks: list[set[int]] = []
    windows = []
    for k, (packed, copies) in enumerate(strings):
        words = Words([packed])
        n = len(words) - window + 1
        marks.append(set(range(n)) if copies > 1 else set())
        if len(strings) > 1:
            windows += [(words.text(j, j + window), k, j) for j in range(n)]
    windows.sort()
    for one, two in zip(windows, windows[1:]):
        if one[0] == two[0]:
            marks[one[1]].add(one[2])
            marks[two[1]].add(two[2])
    spans = []
    for found in marks:
        own: list[tuple[int, int]] = []
        for j in sorted(found):
            if own and j <= own[-1][1]:
                own[-1] = (own[-1][0], j + window)
            else:
                own.append((j, j + window))
        spans.append(own)
    return spans


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
_COUNTED = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("spans", _SPANS)])


def _count_windows(window: int):
    """Reads rows sorted by bucket, one bucket after the other, and gives the repeated spans of each string."""
    def results(bucket: int | None, strings: list[tuple[bytes, int]]) -> list[tuple]:
        return [(bucket, hashlib.md5(packed).digest(), [{"from": a, "to": b} for a, b in spans])
                for (packed, _), spans in zip(strings, repeated_words(strings, window)) if spans]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, strings = None, []
        for batch in batches:
            out = []
            for key, packed, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if key != bucket:
                    out += results(bucket, strings)
                    bucket, strings = key, []
                strings.append((packed, copies))
            yield _table(_COUNTED, *([r[i] for r in out] for i in range(3)))
        out = results(bucket, strings)
        yield _table(_COUNTED, *([r[i] for r in out] for i in range(3)))
    return emit


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_removed and the kept words; the last two columns are the text and the spans to remove."""
    for batch in batches:
        at = batch.num_columns
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(text_bytes(batch.column(at - 2)), batch.column(at - 1).to_pylist()):
            words = text.split()
            left, done = [], 0
            for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
                if b > done:
                    left += words[done:max(a, done)]
                    done = b
            left += words[done:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:at - 1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.string())],
            names=[*batch.schema.names[:at - 1], "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   minimiser: int = MINIMISER) -> DataFrame:
    """For each text with repeated windows: _id, _hash (of the text) and spans, the word ranges to remove.

    1. Each text lists its runs; a run's minimiser is counted. A window's copies share its minimiser, so a
       run whose minimiser occurs once in all the corpus holds no repeated window and never travels.
    2. The others travel as packed strings. Equal ones are counted before buckets are formed, so a passage
       copied any number of times reaches its bucket once. A minimiser with very many runs deals the single
       windows of its distinct strings by their own hash instead, so it does not fill one bucket.
    3. In a bucket, sorting the windows counts them exactly, word for word.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    whole = docs.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
                        F.col(text).alias("_text"))
    row = f"_id {kind}, _hash bigint"
    runs = stored(whole.mapInArrow(_list_runs(window, minimiser),
                                        f"minimiser bigint, {row}, first int, n int"))
    # Stored before the join, so that the planner can split a minimiser with many runs.
    common = stored(runs.groupBy("minimiser").agg(F.count(F.lit(1)).alias("_runs")).filter("_runs > 1").select(
        F.col("minimiser").alias("_m"), (F.col("_runs") > HOT_RUNS).alias("hot")))
    listed = stored(runs.join(common, F.col("minimiser") == F.col("_m")).groupBy(
        F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(
        F.collect_set(F.struct("first", "n", "minimiser", "hot")).alias("_runs")))
    packed = stored(
        whole.join(listed, same_key({"_id": "_i", "_hash": "_h"})).select("_id", "_hash", "_text", "_runs")
        .mapInArrow(_pack_runs(window), f"{row}, first int, hot boolean, bucket bigint, packed binary"))
    cold, hot = (packed.filter(F.col("hot") == F.lit(h)).groupBy("bucket", "packed").agg(
        F.count(F.lit(1)).alias("copies")) for h in (False, True))
    counted = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _count_windows(window), "bucket bigint, digest binary, spans array<struct<from: int, to: int>>")
    found = stored(counted.union(_hot_spans(hot, window)).withColumnsRenamed({"bucket": "_b", "digest": "_d"}))
    hits = packed.select("_id", "_hash", "first", "bucket", F.unhex(F.md5("packed")).alias("digest")).join(
        found, (F.col("bucket") == F.col("_b")) & (F.col("digest") == F.col("_d")))
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("first")).alias("from"),
                                                    (s["to"] + F.col("first")).alias("to")))
    # A text's spans meet as arrays, one for each of its runs; they may overlap.
    return hits.select("_id", "_hash", moved.alias("_moved")).groupBy("_id", "_hash").agg(
        F.flatten(F.collect_list("_moved")).alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    minimiser: int = MINIMISER) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words outside every repeated window.

    A window is ``window`` consecutive words of one text (words end at \\x20 and \\x09-\\x0D and are compared
    unchanged); it is repeated if its words also start anywhere else, in the same text or another. All are
    judged on the input. Kept words are joined by one space. Texts shorter than a window lose nothing; NULL
    and empty texts have no words. A row that comes twice repeats itself, so both lose their windows; rows
    with equal keys and other texts are told apart by the text. NULL keys are a key. All other columns and
    the text are kept; columns called n_words, n_removed or kept_text are replaced.
    """
    spans = stored(repeated_spans(docs, key, text, window, minimiser))
    spans = spans.withColumnsRenamed({"_id": "_i", "_hash": "_h", "spans": "_spans"})
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", text)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"), F.col(key).alias("_id"),
                         F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), F.col(text).alias("_text"))
    rows = packed.join(spans, same_key({"_id": "_i", "_hash": "_h"}), "left").select("_others", "_text", "_spans")
    kind = rows.schema["_others"].dataType.simpleString()
    out = rows.mapInArrow(_remove, f"_others {kind}, _text string, n_words bigint, n_removed bigint, kept_text string")
    return out.select("_others.*", F.col("_text").alias(text), "n_words", "n_removed", "kept_text")
