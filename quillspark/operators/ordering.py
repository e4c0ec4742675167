"""Positions and running totals inside groups of any size.

A window over a whole group would put the group into one task. Here one range sort spreads the rows
over all partitions however large a group is (the sort key ends in a unique column), and each row's
position is its index inside its sort partition plus the group's row count in the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.session import materialise

_ROW, _PART, _FIRST, _BEFORE, _SUM = "_row", "_part", "_first", "_before", "_sum_before"


def _sorted_once(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # monotonically_increasing_id is (sort partition << 33) + index in it; storing it makes it final.
    ordered = df.sort(*groups, *order).withColumn(_ROW, F.monotonically_increasing_id())
    return materialise(ordered).withColumn(_PART, F.shiftright(_ROW, 33))


def _offsets(rows: DataFrame, groups: Sequence[str], value: str | None) -> DataFrame:
    """Per group and sort partition: what lies before it. At most partitions + groups rows."""
    aggregates = [F.min(_ROW).alias(_FIRST), F.count(F.lit(1)).alias("_n")]
    if value:
        aggregates.append(F.sum(value).alias("_s"))
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*groups, _PART).agg(*aggregates)
    columns = [*groups, _PART, _FIRST, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE)]
    if value:
        columns.append(F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(_SUM))
    # Stored, so that the optimiser knows its true size and broadcasts it only when it is small.
    return materialise(counted.select(*columns))


def _located(rows: DataFrame, offsets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with their offsets; a NULL group is a group like any other."""
    names = {c: f"_of_{c}" for c in [*groups, _PART]}
    renamed = offsets.withColumnsRenamed(names)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return rows.join(renamed, same).drop(*names.values())


def with_position(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                  name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in its group. ``order`` has to end in a unique key."""
    rows = _sorted_once(df, groups, order)
    located = _located(rows, _offsets(rows, groups, None), groups)
    return located.withColumn(name, F.col(_BEFORE) + F.col(_ROW) - F.col(_FIRST)).drop(
        _ROW, _PART, _FIRST, _BEFORE)


def with_running_total(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str,
                       name: str = "running_total") -> DataFrame:
    """Add the sum of ``value`` over the row and all rows before it in its group."""
    rows = _sorted_once(df, groups, order)
    located = _located(rows, _offsets(rows, groups, value), groups)
    inside = Window.partitionBy(*groups, _PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    return located.withColumn(name, F.col(_SUM) + F.sum(value).over(inside)).drop(
        _ROW, _PART, _FIRST, _BEFORE, _SUM)
