"""Importance resampling against plain Python, for single words and for pairs and triples."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from quillspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_buckets(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [crc32(g.encode()) % buckets for g in grams]


def plain(rows, target, longest, buckets, percent, least):
    own = [(k, *plain_buckets(t, longest, buckets)) for k, t in rows]
    s = Counter(b for _, _, bs in own for b in bs)
    t = Counter(b for x in target for b in plain_buckets(x, longest, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for key, n, bs in own:
        weight = sum(map(gain.get, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    usable = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {id(r): i + 1 for i, r in enumerate(usable[:percent * len(usable) // 100])}
    return sorted(map(str, ([*r[:4], ranks.get(id(r))] for r in out)))


WORDS = "the of And élan Straße x9 9 zwölf 東京 it's e-mail _under score_ TAIL".split()
ROWS = [(i, " ".join(WORDS[(i * j + j * j) % len(WORDS)] + ("" if j % 3 else f"{i % 7}") for j in range(i % 40))) for i in range(120)]
ROWS += [(500, None), (501, ""), (502, " .,;\x00\x7f"), (503, "one"), (None, "the of " * 15), (504, "same text " * 12),
         (504, "same text " * 12), (505, "long " + "w" * 100 + " tail " * 30), (506, "Ünïcode ÀÉ 🦊 " * 10)]
TARGET = ["the élan of 東京", None, "", "zwölf x9 TAIL tail same"]


@pytest.mark.parametrize("longest, head", [(1, 3), (1, 1000), (2, 4), (3, 5), (2, 0)])
def test_resampled(spark, longest, head):
    docs = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "doc_id bigint, text string, key int, position string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resampled(docs.repartition(4), target, longest=longest, buckets=97, percent=30, least_words=10,
                               most_words=head, most_pairs=head).collect()
    assert sorted(str(list(r)) for r in got) == plain(ROWS, TARGET, longest, 97, 30, 10)


def test_nothing_and_megabytes(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert importance.resampled(none, none.select("text")).count() == 0
    long = " ".join(f"w{i % 90_000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, "")], "doc_id bigint, text string")
    got = importance.resampled(docs, none.select("text"), percent=100).collect()
    assert sorted(str(list(r)) for r in got) == plain([(1, long), (2, "")], [], 1, 10_000, 100, 20)


def test_the_head_is_exact_and_bounded(spark):
    docs = spark.createDataFrame([("b b a a A c",), ("b " + "z" * 80 + " a",), (None,)], "text string")
    assert importance.head_of(docs, most_words=2).words == {w: crc32(w) for w in (b"a", b"b")}
    head = importance.head_of(docs, longest=2, most_words=2, most_pairs=5)
    assert head.pairs == {p: crc32(b" ".join(p)) % 10_000 for p in ((b"a", b"a"), (b"b", b"a"), (b"b", b"b"))}
