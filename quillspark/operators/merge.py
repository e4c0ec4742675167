"""Upsert of one complete scan into the catalog."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

COUNTED_STATES = ["added", "updated", "unchanged", "not_in_latest_search"]
_SEEN = ["first_seen", "last_seen", "in_latest_search"]


def _judged(paired: DataFrame, fields: list[str], known: list[str]) -> DataFrame:
    """Add the state of every (n = incoming, o = stored) pair and whether the stored row is kept."""
    stale = F.struct("n.version", "n.updated") < F.struct("o.version", "o.updated")
    same = reduce(and_, (
        F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}") if c in known else F.lit(None)) for c in fields))
    state = (F.when(F.col("n").isNull(), "not_in_latest_search")
             .when(F.col("o").isNull(), "added")
             .when(stale | same, "unchanged")
             .otherwise("updated"))
    keep_old = F.col("n").isNull() | (F.col("o").isNotNull() & stale)
    return paired.withColumns({"state": state, "_keep": keep_old})


def _outcome(fields: list[str], known: list[str], stamp: str, partial: bool = False) -> list[Column]:
    def old(name: str) -> Column:
        return F.col(f"o.{name}") if name in known else F.lit(None)
    unseen = F.col("n").isNull()
    chosen = [F.when(F.col("_keep"), old(c)).otherwise(F.col(f"n.{c}")).alias(c) for c in fields]
    # A stored row that stays keeps its other columns; a row that the scan replaces has none of them.
    others = [c for c in known if c not in {"id", "state", *_SEEN, *fields}]
    kept = [F.when(F.col("_keep"), F.col(f"o.{c}")).alias(c) for c in others]
    return ["id", *chosen, *kept,
            F.coalesce("o.first_seen", F.lit(stamp)).alias("first_seen"),
            F.when(unseen, F.col("o.last_seen")).otherwise(F.lit(stamp)).alias("last_seen"),
            F.when(unseen, old("in_latest_search") if partial else False).otherwise(True).alias("in_latest_search"),
            "state"]


def merge(old: DataFrame, incoming: DataFrame, stamp: str, repeats: str | None = None,
          partial: bool = False) -> DataFrame:
    """Merge a complete scan: nothing is removed, and an older revision never replaces a newer one. With ``partial`` the
    incoming rows are a part of a scan only, so stored rows that they do not mention keep their in_latest_search.

    The result is the new catalog plus a ``state`` column. Stored columns that the scan lacks stay with the
    stored rows that stay. Rows are matched by one full outer join on
    ``id``. When the scan may hold an id more than once, ``repeats`` names a column with its order;
    each copy is judged against the stored row and the last one that is not stale is kept.
    """
    if repeats:
        return _merge_repeats(old, incoming, stamp, repeats)[0]
    fields = [c for c in incoming.columns if c != "id"]
    known = old.columns
    paired = _packed(incoming, "n").join(_packed(old, "o"), "id", "full_outer")
    return _judged(paired, fields, known).select(*_outcome(fields, known, stamp, partial))


def _packed(df: DataFrame, name: str, *extra: str) -> DataFrame:
    inner = [c for c in df.columns if c not in ("id", *extra)]
    return df.select("id", *extra, F.struct(*inner).alias(name))


def _merge_repeats(old: DataFrame, incoming: DataFrame, stamp: str,
                   order: str) -> tuple[DataFrame, DataFrame]:
    fields = [c for c in incoming.columns if c not in ("id", order)]
    known = old.columns
    new, stored = _packed(incoming, "n", order), _packed(old, "o")
    # A left join lets the adaptive planner split an id that holds a large share of the scan, and the
    # aggregation combines on the map side before it shuffles.
    judged = _judged(new.join(stored, "id", "left"), fields, known)
    latest = judged.groupBy("id").agg(
        F.max_by(F.struct("n", "o", "state", "_keep"), F.struct(~F.col("_keep"), order)).alias("w"))
    seen = latest.select("id", "w.*").select(*_outcome(fields, known, stamp))
    absent = _judged(
        stored.join(new.select("id"), "id", "left_anti").withColumn("n", F.lit(None).cast(
            new.schema["n"].dataType)), fields, known).select(*_outcome(fields, known, stamp))
    states = judged.select("state").unionByName(absent.select("state"))
    return seen.unionByName(absent), states


def merge_with_repeats(old: DataFrame, incoming: DataFrame, stamp: str,
                       order: str) -> tuple[DataFrame, DataFrame]:
    """(merged catalog, one state per incoming copy and per absent stored row)."""
    return _merge_repeats(old, incoming, stamp, order)


def merge_counts(states: DataFrame) -> DataFrame:
    """One row with the four counters of a merge."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in COUNTED_STATES])
