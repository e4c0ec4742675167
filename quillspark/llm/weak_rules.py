"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import words_of
from quillspark.session import materialise

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

GOOD, BAD, ABSTAIN = 1, -1, 0


def base_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the base counts of each whole text, with further counts that the rules read.

    A 3-word window is known by the 64-bit hash of its three words (within one text). Words in a window
    that is found twice or more are counted once each, the first finding included. A NULL or empty text has
    zeros throughout. One row out for each row in; other columns are left behind; nothing is shuffled.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.col(key), content.alias("_text"), words_of(content).alias("_words"))
    last = F.size("_words") - 2
    grams = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1),
                             F.element_at("_words", i + 2))))
    lines = F.filter(F.split("_text", "\n"), lambda s: F.length(F.translate(s, GAPS, "")) > 0)
    second = first.select("*", grams.alias("_grams"), lines.alias("_lines"))
    ordered = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    third = second.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"), ordered))
    near = F.filter("_sorted", lambda x, i: (
        (F.get("_sorted", i - 1)["g"] == x["g"]) | (F.get("_sorted", i + 1)["g"] == x["g"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        near, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    chars = F.length("_text")
    return third.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", GAPS, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (chars - F.length(F.translate("_text", ".,", ""))).cast("long").alias("n_stops"),
        (chars - F.length(F.translate("_text", "!", ""))).cast("long").alias("n_bangs"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"))


def rules() -> dict[str, Column]:
    """Votes on a document, by name: 1 good, -1 bad, 0 abstain.

    A rule about one kind of junk says nothing about a text without it, so it votes bad or abstains. The
    two rules that vote good do so only for texts that are calm in every respect.
    """
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    repeated, symbols = F.col("n_repeat_words") / n, F.col("n_symbols") / n
    capitals, bangs, stops = F.col("n_capitals") / chars, F.col("n_bangs") / n, F.col("n_stops") / n
    calm = (symbols < 0.02) & (bangs < 0.01) & (capitals < 0.15)

    def bad(test: Column) -> Column:
        return F.when(test, BAD).otherwise(ABSTAIN)

    def good(test: Column) -> Column:
        return F.when(test, GOOD).otherwise(ABSTAIN)

    return {
        "symbols": bad(symbols > 0.08),
        "bangs": bad(bangs > 0.05),
        "capitals": bad(capitals > 0.2),
        "repeats": bad(repeated > 0.3),
        "lines": bad((F.col("n_dup_lines") > 2) & (F.col("n_dup_lines") > 0.2 * F.col("n_lines"))),
        "sentences": good(calm & (stops > 0.02) & (stops < 0.6)),
        "varied": good(calm & (repeated < 0.1) & (F.col("n_dup_lines") <= 1)),
    }


def fitted(votes: DataFrame, names: list[str], steps: int = 10) -> dict[str, float]:
    """Estimates by expectation-maximisation how often each rule is right where it votes.

    ``votes`` (one column for each rule) is first counted by pattern: 3 ** rules rows at most, however many
    documents there are. Each step is an aggregate of that small table into one row of sums. The classes
    count as equally likely beforehand, since rules that rarely meet on a document cannot tell a class's
    share. A rule starts at 0.8 and is taken to be right in 55 to 99 of 100 votes, which also tells the
    two classes apart; a rule that never votes keeps its start, as do all on an empty table.
    """
    patterns = materialise(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).coalesce(1))
    right = dict.fromkeys(names, 0.8)
    for _ in range(steps):
        p = posterior(right)
        sums = []
        for n in names:
            sums.append(F.sum(F.when(F.col(n) != ABSTAIN, F.col("_n"))).alias(f"{n}_all"))
            sums.append(F.sum(F.when(F.col(n) == GOOD, p * F.col("_n")).when(
                F.col(n) == BAD, (1 - p) * F.col("_n"))).alias(f"{n}_right"))
        s = patterns.agg(*sums).first()  # one row
        right = {n: min(0.99, max(0.55, s[f"{n}_right"] / s[f"{n}_all"])) if s[f"{n}_all"] else right[n]
                 for n in names}
    return right


def posterior(right: dict[str, float]) -> Column:
    """Chance that a document is good, given the votes in the columns named as the rules."""
    odds = reduce(add, (F.col(n).cast("double") * F.lit(math.log(a / (1 - a))) for n, a in right.items()))
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_from: float = 0.5,
           steps: int = 10) -> DataFrame:
    """Base counts, base_failed, each rule's vote, p_good and kept for every row of ``docs``.

    kept is false where base_failed holds, else p_good >= keep_from. The counts are written once to the
    shared folder (narrow rows), as the fit and the verdict both read them. Repeated rows count as often as
    they come. NULL keys stay NULL. An empty table gives an empty one.
    """
    voted = rules()
    counted = materialise(base_features(docs, key, text).select("*", *[
        v.cast("byte").alias(f"vote_{n}") for n, v in voted.items()]))
    names = [f"vote_{n}" for n in voted]
    model = fitted(counted.select(*names), names, steps)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("p_good", posterior(model)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
