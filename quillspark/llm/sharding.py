"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.ordering import with_position

#: 15 hexadecimal digits of an MD5 make a number below 2**60.
_DIGITS, _RANGE = 15, float(1 << 60)


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard alone decide; a NULL key draws like the text 'null'."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    digits = F.substring(F.md5(F.concat(name, F.lit(f":{shard}")).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(_RANGE)


def assigned(docs: DataFrame, key: str, weights: Sequence[float], shard: str = "shard",
             grown_weight: float | None = None, grown_shard: str = "grown_shard") -> DataFrame:
    """Adds to each row the shard with the highest score -weight / ln(draw), ties to the lowest shard.

    A row's scores for two shards do not depend on a third: a shard that is added takes rows only into
    itself, one that goes gives up its own rows only, and a share changes with its weight alone. With
    ``grown_weight``, ``grown_shard`` tells where the row goes once one more shard of that weight exists.
    Rows with equal keys (repeated rows, NULL keys) meet in one shard. No row moves: this is a projection.
    A column called ``shard`` or ``grown_shard`` is replaced; weights have to be positive.
    """
    if not weights or min([*weights, grown_weight or 1.0]) <= 0:
        raise ValueError("every shard needs a positive weight")

    def score(number: int, weight: float) -> Column:
        return F.struct((F.lit(-float(weight)) / F.log(draw(F.col(key), number))).alias("score"),
                        F.lit(-number).alias("least"))

    best = F.array_max(F.array(*[score(n, w) for n, w in enumerate(weights)]))
    out = docs.withColumn("_best", best)
    if grown_weight is not None:
        more = F.greatest(F.col("_best"), score(len(weights), grown_weight))
        out = out.withColumn(grown_shard, -more["least"])
    return out.withColumn(shard, -F.col("_best")["least"]).drop("_best")


def with_slots(rows: DataFrame, order: Sequence[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds each row's place in its shard, from 0 without gaps; a range sort, so no shard sits in one task.

    ``order`` decides the places; rows that tie in all of it are taken in any order, which changes no
    place's meaning since such rows are the same.
    """
    return with_position(rows, [shard], [F.col(c) for c in order], slot)


def shard_table(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot and
    grown_shard. A NULL text has 0 bytes; other columns are left behind, so none can clash; an empty table
    gives an empty one. Only these narrow rows are sorted."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(key), (F.octet_length(content) + 8).cast("long").alias("size"),
                         F.crc32(content).alias("text_crc32"))
    placed = assigned(narrow, key, weights, grown_weight=grown_weight)
    return with_slots(placed, [key, "text_crc32", "size"]).withColumn("law", F.lit("key")).select(
        key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
