"""Substring dedup against counting every window in a dictionary."""
from __future__ import annotations

from collections import Counter

import pytest

from quillspark.llm import substring_dedup as op

SCHEMA = "doc_id bigint, text string, n_words string, _hash int, first string"


def expected(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def rows_of(spark, rows, window, minimiser):
    table = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], SCHEMA).repartition(3)
    got = op.without_repeats(table, window=window, minimiser=minimiser)
    assert set(got.columns) == {"doc_id", "text", "n_words", "n_removed", "kept_text", "_hash", "first"}
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str)


PASSAGE = "one two three four five six seven eight"
CASES = [
    (1, f"a b {PASSAGE} c d"), (2, f"{PASSAGE}\tx\n\ny"), (3, f"p {PASSAGE} q {PASSAGE} r"),
    (4, None), (5, ""), (6, " \n\t "), (7, "short text"), (8, "same row " * 5), (8, "same row " * 5),
    (9, "first of two texts with one key and more"), (9, "other text under that key which is not alike at all"),
    (None, "no key but this long text is here twice indeed"), (None, "no key but this long text is here twice indeed"),
    (10, "z " * 400), (11, "É ü ñ " * 30), (12, "\x1fnot\x1fa gap \x0b but \x0c these are " + PASSAGE)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_against_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT_RUNS", hot)
    assert rows_of(spark, CASES, 5, 2) == expected(CASES, 5)


def test_empty_table_gives_an_empty_one(spark):
    assert rows_of(spark, [], 5, 2) == []


def test_no_run_holds_two_equal_windows():
    words = op.Words([b"a b " * 50, b"a b c d e f g h"])
    text, first, n, _ = op.runs_of(words, 6, 2)
    windows = Counter()
    for t, f, k in zip(text, first, n):
        base = words.first[t]
        own = [words.text(base + f + j, base + f + j + 6) for j in range(k)]
        assert len(set(own)) == len(own)
        windows[t] += k
    assert windows == {0: 95, 1: 3}
