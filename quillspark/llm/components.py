"""Connected components of a link table, by alternating star contractions with written tables between."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import gathered, materialise

MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(
        links.select(F.col("b").alias("v"), F.col("a").alias("u")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of v is linked to the least of v and its neighbours. One row for each link; equal ones
    are left to the small star."""
    both = _both_ways(links)
    least = both.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
    m = F.least("m", "v")
    return both.filter("u > v").join(least, F.col("v") == F.col("w")).select(m.alias("a"), F.col("u").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """v and its smaller neighbours are linked to the least of them. links hold a < b."""
    least = links.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
    joined = links.join(least, F.col("b") == F.col("w"))
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b").union(
        least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    """The number of the distinct links a < b, and of the nodes that are neither a root nor linked to one root only.
    Without such nodes, no round changes the links."""
    ends = links.select(F.col("a").alias("v"), F.lit(0).alias("up")).union(
        links.select(F.col("b").alias("v"), F.lit(1).alias("up")))
    nodes = ends.groupBy("v").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    found = nodes.agg(F.sum("n"), F.count(F.when((F.col("n") > 1) | (F.col("n") > F.col("least")), 1))).first()
    return found[0] or 0, found[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of ``links`` (a, b: two columns of numbers).

    Links of a node to itself, repeated ones and their direction do not matter; NULLs are ignored; no links
    give no rows. Rounds end when all that is left are stars, which one aggregate tells. A round is two aggregates and two joins that the adaptive planner can split, and is
    written to the shared folder, so no lineage grows and no component meets in one task. The number of
    rounds grows with the logarithm of the longest path.
    """
    a, b = links.columns
    now = materialise(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct())
    for _ in range(MOST_ROUNDS):
        rows, others = _state(now)
        if not others:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        now = materialise(gathered(_small_star(_large_star(now)), rows))
    raise RuntimeError("the components did not settle")
