"""Character budgets: keep the leading rows that fit and say when rows were left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions import render
from quillspark.operators.ranking import numbered


def leading_rows(df: DataFrame, order: list[Column], length: str, budget: int, shortest: int,
                 used: int = 0) -> DataFrame:
    """The leading rows whose running ``used`` total stays within ``budget``, with that total.

    Every row costs at least ``shortest``, so no row beyond the first ``budget / shortest`` can fit.
    A distributed top-k therefore loses nothing, and the window below sees only that many rows.
    """
    fitting = max(0, (budget - used) // shortest)
    head = df.orderBy(*order).limit(fitting)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("used", used + F.sum(length).over(running)).where(F.col("used") <= budget)


def search_blocks(top: DataFrame, abstracts: bool = False, max_chars: int = 12000) -> DataFrame:
    """The printed block of each ranked hit (at most 50) and whether it fits the budget."""
    blocks = numbered(top).select("rank", "id", render.search_block(abstracts).alias("block"))
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = len(fixed.SEARCH_HEAD) + F.sum(F.length("block")).over(running)
    return blocks.withColumn("used", used).withColumn(
        "shown", F.col("used") <= max_chars - fixed.SEARCH_NOTICE_RESERVE)


def search_page(blocks: DataFrame) -> str:
    """The text of a search: at most 50 budgeted blocks."""
    rows = blocks.orderBy("rank").collect()
    shown = [r.block for r in rows if r.shown]
    tail = fixed.SEARCH_OVERFLOW if len(shown) < len(rows) else "" if rows else fixed.SEARCH_EMPTY
    return fixed.SEARCH_HEAD + "".join(shown) + tail


def card_budget(max_chars: int) -> int:
    return max_chars - len(fixed.SHOW_OVERFLOW) - 1


def fitting_cards(cards: DataFrame, order: list[Column], max_chars: int) -> DataFrame:
    """The leading cards that fit; each costs its length plus a line break."""
    # The budget is tested before the line break is charged, hence the one extra character.
    priced = cards.withColumn("cost", F.length("content") + 1)
    return leading_rows(priced, order, "cost", card_budget(max_chars) + 1,
                        shortest=len(fixed.CARD_NOTICE)).drop("cost")
