"""Document fingerprints by winnowing: rolling hashes, the least of each window, positions kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import pieces, python_ready, span_hashes

#: Any passage of WINDOW + GRAM - 1 = 48 code points that two texts share shows up in both fingerprints.
GRAM, WINDOW = 16, 33
_LOW = np.uint64(0xFFFFFFFF)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The least of every ``window`` consecutive values, by windows of doubling size."""
    size, least = 1, values
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def fingerprints_of(texts: list[str], gram: int = GRAM,
                    window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the chosen 32-bit hashes, in the order of the text, and their positions.

    Every ``gram`` consecutive code points have a rolling hash; of every ``window`` consecutive hashes the
    least is chosen, of equal ones the rightmost. A text with fewer hashes than a window is one window; one
    shorter than a gram has the hash of the whole; an empty one has none.
    """
    codes = [_codes(t) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    values = np.concatenate([*codes, np.zeros(0, np.uint32)])
    offset = np.cumsum(sizes) - sizes
    grams = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(texts)), grams)
    place = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = offset[text] + place
    end = np.minimum(begin + gram, (offset + sizes)[text])
    hashes = span_hashes(values, begin, end)
    # The hash above, the position below and counted down: of equal hashes the rightmost is least.
    ranked = (hashes & ~_LOW) | (_LOW - place.astype(np.uint64))
    first = np.cumsum(grams) - grams
    short = np.flatnonzero((grams > 0) & (grams <= window))
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * len(texts)
    for i in short:
        out[i] = _chosen(ranked[first[i]:first[i] + grams[i]].min()[None])
    if len(ranked) > window:
        minima = _window_minima(ranked, window)
        for i in np.flatnonzero(grams > window):
            own = minima[first[i]:first[i] + grams[i] - window + 1]
            out[i] = _chosen(own[np.flatnonzero(np.diff(own, prepend=~own[:1]))])
    return out


def _chosen(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ranked >> np.uint64(32)).astype(np.uint32), (_LOW - (ranked & _LOW)).astype(np.int64)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Shared hashes by all hashes; two texts without any are alike."""
    if not len(one) and not len(two):
        return 1.0
    a, b = np.unique(one), np.unique(two)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the first of ``following``."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _columns(kind: pa.DataType, name: str) -> pa.Schema:
    prints, places = pa.list_(pa.int64()), pa.list_(pa.int64())
    return pa.schema([
        (name, kind), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("hashes", prints),
        ("positions", places), ("edited_hashes", prints), ("edited_positions", places),
        ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(name: str, gram: int, window: int):
    """Reads rows sorted by bucket and key; a row waits for the one after it."""
    def results(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """rows: (own, key, text, is the next row its next document); the last one only follows."""
        for cut in pieces([4 * len(r[2]) for r in rows[:-1]]):
            texts = [r[2] for r in rows[cut.start:cut.stop + 1]]
            own = range(len(texts) - 1)
            nexts = [texts[i + 1] if rows[cut.start + i][3] else "" for i in own]
            changed = [edited(texts[i], nexts[i]) for i in own]
            prints, after = fingerprints_of(texts, gram, window), fingerprints_of(changed, gram, window)
            nothing = np.zeros(0, np.uint32)
            kept = [i for i in own if rows[cut.start + i][0]]
            yield pa.RecordBatch.from_pylist([{
                name: rows[cut.start + i][1], "n_chars": len(texts[i]),
                "edited_sha256": hashlib.sha256(changed[i].encode()).hexdigest(),
                "hashes": prints[i][0], "positions": prints[i][1],
                "edited_hashes": after[i][0], "edited_positions": after[i][1],
                "near_edited": likeness(prints[i][0], after[i][0]),
                "near_next": likeness(prints[i][0], prints[i + 1][0] if rows[cut.start + i][3] else nothing),
            } for i in kept], schema=_columns(kind, name))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, kind = [], None
        for batch in batches:
            kind = batch.column(2).type
            part, guest, keys, texts = (batch.column(i).to_pylist() for i in range(4))
            new = [[not g, k, t or "", p, g] for p, g, k, t in zip(part, guest, keys, texts)]
            rows = waiting + new
            ready = [(a[0], a[1], a[2], a[3] == b[3] and a[1] is not None)
                     for a, b in zip(rows, rows[1:])]
            if ready:
                last = rows[-1]
                yield from results([*ready, (False, last[1], last[2], False)], kind)
            waiting = rows[-1:]
        if waiting:
            own, key, text = waiting[0][:3]
            yield from results([(own, key, text, False), (False, None, "", False)], kind)
    return emit


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM,
             window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: key, n_chars, the fingerprint (hashes and positions) of its text and of its
    edited text (see edited), the edited text's SHA-256, and the likeness of its fingerprint to the edited
    text's and to that of the next document in ascending order of the key; after the last comes the first.

    Rows meet their neighbours by one shuffle: the keys' quantiles bound the buckets, rows of a bucket are
    sorted, and the few rows with a bound as their key go to the bucket before as well. Rows with equal keys
    follow one another by text. A row with a NULL key has no place in that order: its next document counts as
    empty. NULL texts are empty. Other columns are left behind. An empty table gives an empty one. Keys are
    whole numbers.
    """
    spark = docs.sparkSession
    python_ready(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.lit([i / parts for i in range(1, parts)])
    row = docs.agg(F.min(key), F.percentile_approx(key, shares, 10 * parts + 10_000)).first()
    bounds = np.unique(np.array([v for v in [row[0], *(row[1] or [])] if v is not None], np.int64))

    @F.pandas_udf("array<int>")
    def buckets(keys: pd.Series) -> pd.Series:
        """The row's bucket, and the bucket before where the row is that one's neighbour."""
        known = keys.notna().to_numpy()
        values = keys.fillna(0).to_numpy(np.int64)
        at = np.searchsorted(bounds, values, "right") - 1
        is_bound = known & (at >= 0) & (bounds[np.maximum(at, 0)] == values) if len(bounds) else ~known & known
        return pd.Series([[int(b), int(b - 1) if b else len(bounds) - 1] if n else [int(b)]
                          for b, n in zip(at, is_bound)])

    dealt = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text")).select(
        "*", F.posexplode(buckets("_id")).alias("_guest", "_bucket")).select(
        F.when(F.col("_id").isNull(), -1 - F.pmod(F.hash("_text"), F.lit(parts))).otherwise(
            F.col("_bucket")).alias("_bucket"), (F.col("_guest") > 0).alias("_guest"), "_id", "_text")
    sorted_rows = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_guest", "_id", "_text")
    kind = f"`{key}` bigint"
    return sorted_rows.mapInArrow(
        _compare(key, gram, window),
        f"{kind}, n_chars bigint, edited_sha256 string, hashes array<bigint>, positions array<bigint>, "
        "edited_hashes array<bigint>, edited_positions array<bigint>, near_edited double, near_next double")


def as_text(hashes: str):
    """A fingerprint's hashes as one string of 8 hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), ""))
