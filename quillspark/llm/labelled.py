"""A bounded sample of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held_out: int,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, label, _text): up to ``most`` labelled rows outside the held-out fold.

    Those with the least hash of their key are taken, half of them of each label if there are enough, so the
    sample is the same on each run and has a bounded size, by which its keys may be broadcast. Rows without a
    label, a key or a document do not count.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key, folds) != held_out))
    usable = usable.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    order = [F.xxhash64("_key"), F.col("_key"), F.col("label")]
    half = [usable.filter(F.col("label") == v).orderBy(*order).limit(most // 2) for v in (0, 1)]
    chosen = F.broadcast(half[0].union(half[1]))
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key").select(
        "_key", "label", "_text")
