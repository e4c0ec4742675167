"""Winnowing against choosing window by window."""
from __future__ import annotations

import hashlib

import numpy as np

from quillspark.llm import winnowing as op
from quillspark.llm.common import span_hashes

SHARED = "this very passage of at least forty-eight characters stands in both of them"


def plain_hash(codes):
    """The hash of a gram in whole numbers: a sum of powers, then two rounds of multiply and shift."""
    most, h, power = (1 << 64) - 1, 0, 1
    for c in codes:
        h = (h + (c + 1) * power) & most
        power = power * 0x9E3779B97F4A7C15 & most
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * factor) & most
    return h ^ (h >> 31)


def test_hashes_of_grams():
    text = "Some words — é中🦊 and more of them."
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begin = np.arange(len(codes) - op.GRAM + 1)
    assert span_hashes(codes, begin, begin + op.GRAM).tolist() == [
        plain_hash(map(ord, text[i:i + op.GRAM])) for i in begin.tolist()]


def test_the_query_tells_the_positions(spark):
    from quillspark.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.winnowed(spark, folder).limit(40).collect():
        want = brute(texts[r.doc_id])
        assert r.positions == ",".join(str(p) for _, p in want)
        assert r.fingerprint == "".join(f"{h:08x}" for h, _ in want)


def brute(text, gram=op.GRAM, window=op.WINDOW):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return []
    gram = min(gram, len(codes))
    begin = np.arange(len(codes) - gram + 1)
    hashes = (span_hashes(codes, begin, begin + gram) >> np.uint64(32)).tolist()
    window, chosen = min(window, len(hashes)), set()
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i:i + window])
        chosen.add(max(p for p in range(i, i + window) if hashes[p] == least))
    return [(hashes[p], p) for p in sorted(chosen)]


TEXTS = ["", "a", "abc", "x" * 15, "x" * 16, "x" * 49, "ab" * 400, "é中" * 30, "\U0001f600" * 60, "the quick brown fox " * 9,
         f"start {SHARED} end of the first one, which goes on", f"other words, then {SHARED}", "n" * 5000]


def test_choices_match_and_ties_go_right():
    for one, text in zip(op.fingerprints_of(TEXTS), TEXTS):
        assert list(zip(one[0].tolist(), one[1].tolist())) == brute(text), text
    assert op.fingerprints_of(["x" * 60])[0][1].tolist() == list(range(32, 45))


def test_match_guarantee():
    a, b = (set(op.fingerprints_of([t])[0][0].tolist()) for t in TEXTS[10:12])
    assert a & b


def test_neighbours_over_buckets(spark):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS * 3)] + [(7, None), (6, "twice"), (6, "again"), (6, "again")]
    table = spark.createDataFrame([(k, t, "c") for k, t in rows] + [(None, SHARED * 2, "c")],
                                  "doc_id bigint, text string, hashes string").repartition(4)
    got = op.compared(table).collect()
    assert len(got) == len(rows) + 1
    ordered = sorted((k, t or "") for k, t in rows)
    want = []
    for i, (k, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        quarter = len(t) // 4
        changed = t[:len(t) - quarter] + following[:quarter]
        prints = [[h for h, _ in brute(x)] for x in (t, changed, following)]
        want.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1],
                     op.likeness(*map(np.array, prints[:2])), op.likeness(*map(np.array, prints[::2]))))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.hashes, r.edited_hashes, r.near_edited, r.near_next)
            for r in got if r.doc_id is not None]
    assert sorted(have, key=str) == sorted(want, key=str)
    lost = [r for r in got if r.doc_id is None]
    assert len(lost) == 1 and lost[0].n_chars == 2 * len(SHARED) and lost[0].near_next == 0.0
    assert op.compared(table.limit(0)).count() == 0
    one = op.compared(table.filter("doc_id = 39")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
