"""Mixing sources to target weights: token budgets handed down a tree, then a prefix of seeded epochs.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.common import same_key, words_of
from quillspark.operators.ordering import with_running_total
from quillspark.session import materialise

_DIGITS = 15


def epoch_order(key: Column, epoch: Column, seed: int) -> Column:
    """A number that seed, epoch and key decide; each epoch deals the documents of a leaf anew."""
    name = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"),
                    F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def _shared_out(nodes: DataFrame, path: Sequence[str], weight: str, capacity: str, given: str,
                name: str) -> DataFrame:
    """Splits each parent's ``given`` tokens among its children by weight; none gets beyond its capacity.

    Children fill up in ascending order of capacity / weight, and what the full ones leave is split again
    among their siblings. Whole numbers throughout; a remainder of less than one token a child is not dealt.
    """
    parent = list(path[:-1])
    order = [(F.col(capacity).cast("double") / F.col(weight)).asc(), F.col(path[-1]).asc()]
    above = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    so_far = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = nodes.withColumn("_spent", F.coalesce(F.sum(capacity).over(above), F.lit(0))).withColumn(
        "_rest", F.sum(weight).over(onward))
    # A child is full if its share of what is left to it and to those after it reaches its capacity.
    step = step.withColumn("_part", F.expr(f"greatest({given} - _spent, 0L) * {weight} div _rest"))
    step = step.withColumn("_full", F.col("_part") >= F.col(capacity))
    step = step.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct("_spent", "_rest"))).over(
        Window.partitionBy(*parent)))
    # Once one child is not full, none after it is; all of those share by the same level.
    first = F.min(F.when(~F.col("_full"), F.lit(1))).over(so_far)
    level = F.expr(f"greatest({given} - _open._spent, 0L) * {weight} div _open._rest")
    return step.withColumn(name, F.when(first.isNull(), F.col(capacity)).otherwise(
        F.least(F.col(capacity), level))).drop("_spent", "_rest", "_part", "_full", "_open")


def budgets(supply: DataFrame, weights: DataFrame, path: Sequence[str], budget: int,
            max_epochs: int) -> DataFrame:
    """The token quota of every leaf.

    supply: the path columns and ``tokens``, one row for each leaf. weights: a row for each node of the
    tree, with the path columns (NULL below the node) and an integer ``weight``; a node without a row has
    weight 1, a weight of 0 or less takes nothing. A leaf can give ``max_epochs`` times its tokens, an inner
    node the sum of its leaves. The budget goes down from the root, at each node among its children first:
    a shortage is made up by siblings, and it reaches an ancestor's siblings only when all of them are full.
    A tree is as small as its list of leaves, so its levels are windows over that list.
    """
    leaf = list(path)
    nodes = supply.withColumn("_cap", (F.col("tokens") * max_epochs).cast("long"))
    for depth in range(len(leaf), 0, -1):
        names = leaf[:depth]
        own = weights.filter(F.col(names[-1]).isNotNull() & (
            F.col(leaf[depth]).isNull() if depth < len(leaf) else F.lit(True)))
        own = own.groupBy(*names).agg(F.max("weight").cast("long").alias(f"_w{depth}"))
        own = own.withColumnsRenamed({n: f"_of_{n}" for n in names})
        nodes = nodes.join(own, same_key({n: f"_of_{n}" for n in names}), "left").drop(
            *[f"_of_{n}" for n in names]).withColumn(
            f"_w{depth}", F.coalesce(F.col(f"_w{depth}"), F.lit(1)).cast("long"))
        nodes = nodes.withColumn("_cap", F.when(F.col(f"_w{depth}") > 0, F.col("_cap")).otherwise(0))
    given = nodes.withColumn("_g0", F.lit(int(budget)).cast("long"))
    for depth in range(1, len(leaf) + 1):
        names = leaf[:depth]
        level = given.groupBy(*names).agg(
            F.sum("_cap").alias("_c"), F.max(F.greatest(F.col(f"_w{depth}"), F.lit(1))).alias("_w"),
            F.max(f"_g{depth - 1}").alias("_g"))
        shared = _shared_out(level, names, "_w", "_c", "_g", f"_g{depth}").select(
            *[F.col(n).alias(f"_of_{n}") for n in names], f"_g{depth}")
        given = given.join(shared, same_key({n: f"_of_{n}" for n in names})).drop(*[f"_of_{n}" for n in names])
    return given.select(*leaf, "tokens", F.col(f"_g{len(leaf)}").alias("quota"))


def mixed_rows(docs: DataFrame, weights: DataFrame, path: Sequence[str], budget_share: float = 0.5,
               budget: int | None = None, max_epochs: int = 4, seed: int = 0, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, the path, n_tokens, the leaf's tokens and quota, and copies.

    Tokens are words. The budget is ``budget``, or ``budget_share`` of all tokens. A leaf's stream is its
    documents, dealt anew by (seed, epoch) in each epoch; the leaf gives the prefix of that stream that
    its quota covers, so copies is the number of whole epochs plus one for the documents that begin before
    the quota ends in the last one. The document in which it ends is taken whole. Documents without words
    cost nothing and come with each epoch begun.
    Running totals are summed over a range sort of narrow rows, so a leaf with most of the rows is spread
    over all tasks. A NULL in the path is a value like others. Rows with equal keys are ordered by their
    tokens, and equal ones in any order. An empty table gives an empty one.
    """
    leaf = [f"_leaf{i}" for i in range(len(path))]
    rows = materialise(docs.select(
        F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(path, leaf)],
        F.size(words_of(F.col(text))).cast("long").alias("_tokens")))
    supply = rows.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens"))
    own = weights.withColumnsRenamed(dict(zip(path, leaf)))
    if budget is None:
        budget = int((rows.agg(F.sum("_tokens")).first()[0] or 0) * budget_share)  # one number
    quotas = materialise(budgets(supply, own, leaf, budget, max_epochs).select(
        *[F.col(n).alias(f"_of_{n}") for n in leaf], F.col("tokens").alias("leaf_tokens"), "quota"))
    joined = rows.join(quotas, same_key({n: f"_of_{n}" for n in leaf})).drop(*[f"_of_{n}" for n in leaf])
    full = F.when(F.col("leaf_tokens") > 0, F.expr("quota div leaf_tokens")).otherwise(0)
    dealt = joined.withColumn("_full", full).withColumn(
        "_rest", F.col("quota") - F.col("_full") * F.col("leaf_tokens")).withColumn(
        "_order", epoch_order(F.col("_key"), F.col("_full"), seed))
    running = with_running_total(dealt, leaf, [F.col("_order"), F.col("_key"), F.col("_tokens")], "_tokens",
                                 "_upto")
    begins = F.col("_upto") - F.col("_tokens")
    return running.select(
        F.col("_key").alias(key), *[F.col(n).alias(c) for c, n in zip(path, leaf)],
        F.col("_tokens").alias("n_tokens"), "leaf_tokens", "quota",
        (F.col("_full") + (begins < F.col("_rest")).cast("long")).cast("long").alias("copies"))
