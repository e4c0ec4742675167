"""Target-distribution importance resampling over hashed word features, with a head-tail vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready, stored, text_bytes
from quillspark.operators.ordering import with_position

#: Hash buckets, the longest run of words that is a feature, and the share of documents that is drawn, in percent.
BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: The head: so many of the most frequent words and pairs, of at most so many bytes. With that the broadcast is bounded.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 20_000, 20_000, 64
#: Counts that a task holds before it gives them out.
_COUNTED_AT_ONCE = 200_000
#: A-Z become a-z; every ASCII character that is neither letter nor digit ends a word.
_TO_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Head(NamedTuple):
    """words: the CRC state after a frequent word; pairs: the bucket of a frequent pair, by both words' CRC states and
    words, so that it need not be joined."""

    words: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]


def buckets_of(words: list[bytes], head: Head, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The bucket of every run of 1 to ``longest`` words: crc32 of the words joined by one space, modulo ``buckets``.

    A word of the head brings its CRC state, any other is hashed; a longer run goes on from the state of the run
    without its last word, or takes its bucket from the head.
    """
    states = list(map(head.words.get, words))
    if None in states:
        states = [crc32(w) if s is None else s for w, s in zip(words, states)]
    out = [s % buckets for s in states]
    for size in range(2, longest + 1):
        last = words[size - 1:]
        known = map(head.pairs.get, zip(words, last)) if size == 2 else repeat(None)
        if size < longest:  # the next longer runs go on from here
            states = [crc32(w, crc32(b" ", s)) for s, w in zip(states, last)]
            out += [s % buckets for s in states]
        else:
            out += [crc32(w, crc32(b" ", s)) % buckets if b is None else b for s, w, b in zip(states, last, known)]
    return out


def _count_grams(size: int, head: Head | None = None):
    """Counts words, or with ``head`` the pairs of its words; gives bytes and counts, each gram once in a while."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            grams = [b" ".join(g) if size > 1 else g for g in counts]
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                             names=["gram", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                words = words_of(text)
                if size == 1:
                    counts.update(words)
                else:
                    known = [w in head.words for w in words]
                    counts.update(p for p, a, b in zip(zip(words, words[1:]), known, known[1:]) if a and b)
                if len(counts) > _COUNTED_AT_ONCE:
                    yield given()
        yield given()
    return emit


#: Frequencies between which the head's limit is looked for.
_STEPS = sorted({math.ceil(2 ** (k / 4)) for k in range(4 * 62)})


def _most_frequent(texts: DataFrame, counting, most: int) -> list[bytes]:
    """The grams whose exact count reaches a limit: the least of _STEPS that no more than ``most`` grams reach. So the
    driver gets ``most`` rows at the utmost, and no task has to send it its own best ones."""
    counts = stored(texts.mapInArrow(counting, "gram binary, n bigint").filter(
        F.octet_length("gram") <= HEAD_BYTES).groupBy("gram").agg(F.sum("n").alias("n")))
    above = counts.agg(*[F.count_if(F.col("n") >= s) for s in _STEPS]).first()
    limit = next(s for s, n in zip(_STEPS, above) if n <= most)
    return [bytes(r.gram) for r in counts.filter(F.col("n") >= limit).collect()]


def head_of(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
            most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> Head:
    """The head of a table's vocabulary, by exact counts over all its texts; most_words and most_pairs bound it."""
    python_ready(docs.sparkSession)
    texts = docs.select(F.col(text))
    head = Head({w: crc32(w) for w in _most_frequent(texts, _count_grams(1), most_words)}, {})
    if longest > 1:
        for pair in _most_frequent(texts, _count_grams(2, head), most_pairs):
            first, second = pair.split(b" ")
            head.pairs[first, second] = crc32(second, crc32(b" ", head.words[first])) % buckets
    return head


def _list_buckets(head: Head, longest: int, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for cut in pieces([len(t) for t in texts]):
                counts, flat, ends = [], [], [0]
                for text in texts[cut]:
                    words = words_of(text)
                    counts.append(len(words))
                    flat += buckets_of(words, head, longest, buckets)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(cut.start, len(counts)), pa.array(counts, pa.int64()), lists],
                    names=["key", "n_words", "buckets"])
    return emit


def features(docs: DataFrame, head: Head, key: str = "doc_id", text: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS) -> DataFrame:
    """key, n_words and buckets (one number for each feature) of every whole text; NULL and empty texts have none."""
    python_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        _list_buckets(head, longest, buckets), f"key {kind}, n_words bigint, buckets array<int>")


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; the driver gets one row for each bucket at most."""
    totals = np.zeros(buckets, np.int64)
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        totals[r.b] = r["count"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the source, in doubles."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(gain[np.asarray(lists.values)])))
            n = np.diff(ends)
            own = total[ends[1:]] - total[ends[:-1]]
            weight = np.where(n > 0, np.floor_divide(own, np.maximum(n, 1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)],
                                             names=["key", "n_words", "n_features", "weight"])
    return emit


def gumbel(key: Column, seed: str = SEED) -> Column:
    """floor(1000 g) for a Gumbel variate g that the key and the seed decide. A NULL key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST,
              buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
              most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of ``docs``; ``target`` has a column ``text``.

    weight is the floored mean of the gains of a text's features (0 without any), score adds Gumbel noise, and rank
    numbers the drawn rows: of those with ``least_words`` words or more, ``percent`` in a hundred with the highest
    scores, ties to the smaller key. Others have no rank. Which words are in the head changes the time only. NULL
    keys come before all others; rows that repeat key and text get equal scores and ranks next to each other; an
    empty table gives no rows. Other columns are left behind.
    """
    head = head_of(docs, text, longest, buckets, most_words, most_pairs)
    rows = stored(features(docs, head, key, text, longest, buckets))
    wanted = features(target.select(F.lit(0).alias("key"), "text"), head, "key", "text", longest, buckets)
    gain = gains(bucket_totals(rows, buckets), bucket_totals(wanted, buckets))
    kind = rows.schema["key"].dataType.simpleString()
    weighed = rows.mapInArrow(_weigh(gain), f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    scored = stored(weighed.withColumns({"score": F.col("weight") + gumbel(F.col("key"), seed),
                                         "usable": F.col("n_words") >= least_words}))
    drawn = scored.filter("usable").count() * percent // 100
    placed = with_position(scored, [], [F.desc("usable"), F.desc("score"), F.asc("key"), F.asc("n_features")])
    rank = F.when(F.col("usable") & (F.col("position") < drawn), F.col("position") + 1)
    return placed.select(F.col("key").alias(key), "n_features", "weight", "score", rank.cast("bigint").alias("rank"))
