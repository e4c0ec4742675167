"""The filter audit against documents removed one by one, and its transducer and table against plain Python."""

import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


ODD = ["", " ", "\n\t \x0b\x0c\r", "a", "a a", "A b   c", "É É é", "🦊 fox🦊 🦊", "#|x$ %&* -", "x" * 100, "aaaaaaaab aaaaaaaac aaaaaaaab",
       "\x00 \x00", "\x1f \x85", "ÿ" * 9 + " " + "ÿ" * 9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abA #é\n🦊", max_size=60), max_size=8))
def test_measures(texts):
    texts = texts + ODD
    got = filter_audit.measures([t.encode() for t in texts])
    assert got.tolist() == [plain_measures(t) for t in texts]


def test_measures_of_nothing_and_of_megabytes():
    assert filter_audit.measures([]).shape == (0, 5)
    text = ("Wörter und words %d " * 150_000) % tuple(i % 70_000 for i in range(150_000))
    assert len(text.encode()) > 2_000_000
    assert filter_audit.measures([text.encode(), b"x"]).tolist() == [plain_measures(text), [1, 1, 0, 1, 0]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two one three two", "one one", "longer-than-eight longer-than-eighT longer-than-eight"]
    assert filter_audit.measures([t.encode() for t in texts])[:, 1].tolist() == [3, 1, 2]


def plain_audit(rows, labels):
    good, toxic = ({k for k, q, t in labels if (q, t)[i] == 1 and k is not None} for i in (0, 1))
    failed = []
    for i, (key, part, text) in enumerate(rows):
        t = text or ""
        words, distinct, capitals, points, symbols = plain_measures(t)
        bad = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * points, "D": symbols > 0,
               "E": key is not None and any(k is not None and k < key and (o or "") == t for k, _, o in rows)}
        failed.append((key, part or "", {k for k, v in bad.items() if v}))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(k, f) for k, p, f in failed if p == part]
        removed_in = {}
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, letter in enumerate(order, 1):
                here = [r for r in alive if letter in r[1]]
                alive = [r for r in alive if letter not in r[1]]
                out[part, "".join(order), step] = [
                    len(alive), len(here), sum(letter in f for _, f in own) - len(here),
                    sum(f == {letter} for _, f in own), sum(k in good for k, _ in here), sum(k in toxic for k, _ in here)]
                removed_in[letter] = removed_in.get(letter, 0) + len(here)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_in[order[step - 1]])
    return out


LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [(1, "a", LONG), (2, "a", LONG), (3, "b", LONG), (3, "b", LONG), (4, None, None), (5, "", ""), (6, "a", "x"),
        (None, "b", LONG), (None, "b", "y"), (7, "b", "y"), (8, "b", "CAPS # " * 150), (9, "a", "w w w " * 100),
        (10, "c", LONG + " $"), (0, "c", "CAPS"), (11, "b", "A" + LONG * 3), (12, "b", "A" + LONG * 3)]


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 5, "z") for r in ROWS], "doc_id bigint, source string, text string, part int, digest string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 1), (3, 0, 1), (6, 1, None), (9, None, 1), (99, 1, 1), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(docs.repartition(3), labels).collect()}
    assert got == plain_audit(ROWS, [tuple(r) for r in labels.collect()])


@pytest.mark.parametrize("rows", [[], [(1, "a", None)]])
def test_audit_of_little(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == 600 * len(rows)
    assert {(r.kept, r.removed) for r in got if r.filter_order[0] == "A"} == ({(0, 1), (0, 0)} if rows else set())
