"""Near copies against the exact Jaccard similarity of all pairs."""
from __future__ import annotations

import random

import numpy as np

from quillspark.llm import near_copies, stages


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(share, n, seed, words=250):
    """Pairs of a text and its copy with a share of its words, one at least, changed."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy = list(own)
        for i in rng.sample(range(words), max(1, round(share * words))):
            copy[i] = f"x{rng.randrange(5000)}"
        out.append((" ".join(own), " ".join(copy)))
    return out


def test_every_pair_of_the_small_table_is_found(spark):
    """Recall against all pairs: none of the links of sf0.001 is lost, and none is invented."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in near_copies.classes(docs).collect()}
    rows = [(r.doc_id, frozenset(shingles(r.text))) for r in docs.collect()]
    root = {k: k for k, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for i, (k, a) in enumerate(rows):
        for m, b in rows[:i]:
            both = len(a & b)
            if a == b or (both and 5 * both >= 4 * len(a | b)):
                links += 1
                low, high = sorted((top(k), top(m)))
                root[high] = low
    assert links > 10 and got == {k: top(k) for k in root}


def test_parity_maps_lose_no_link():
    rng = random.Random(4)
    for words in (8, 60, 400, 3000):
        for one, two in planted(0.015, 6, rng.random(), words):
            a, b = near_copies.shingle_sets([one.encode(), two.encode()])
            maps = near_copies._parities([a, b]).view(np.uint8)
            differ = int(np.unpackbits(maps[0] ^ maps[1]).sum())
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_a_group_of_texts_that_are_alike_but_not_enough(spark):
    """Its members meet in the same buckets; none of its pairs, whose number grows with its square, is compared."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    rows = []
    for k in range(120):
        own = list(base)
        for i in rng.sample(range(250), 9):
            own[i] = f"y{rng.randrange(9000)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id bigint, text string")
    assert sum(jaccard(a[1], b[1]) >= 0.8 for i, a in enumerate(rows) for b in rows[:i]) == 0
    asked = []
    old, near_copies._verified = near_copies._verified, lambda pairs, texts: asked.append(pairs.count()) or old(pairs, texts)
    try:
        got = near_copies.classes(docs).collect()
    finally:
        near_copies._verified = old
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((k, k) for k, _ in [*rows, *rows[:5]])
    assert sum(asked) < 120


def test_rows_that_repeat_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i % 90_000}" for i in range(300_000))
    rows = [(1, long, 0, "a"), (2, long + " tail", 0, "b"), (1, long, 0, "a"), (3, "short one here", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size int, key string")
    got = sorted((r.doc_id, r.component_id) for r in near_copies.classes(docs).collect())
    assert len(long) > 1_500_000 and got == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_planted_edits_are_found(spark):
    pairs = planted(0, 100, 1) + planted(0.01, 100, 2) + planted(0.02, 100, 3) + planted(0.06, 100, 4)
    rows = [(2 * i + j, p[j], "en", "src0", len(p[j])) for i, p in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in stages.one_of_each(spark, docs, "").collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    similar = [jaccard(*p) >= 0.8 for p in pairs]
    removed = [2 * i + 1 not in kept for i in range(len(pairs))]
    assert not any(r and not s for r, s in zip(removed, similar))
    for group in (0, 100):
        assert all(removed[group:group + 100])
    wanted = sum(similar[200:300])
    print("recall at 2% of the words:", sum(removed[200:300]), "of", wanted)
    assert wanted > 50 and sum(removed[200:300]) >= 0.95 * wanted
    assert not any(removed[300:])


def test_groups_and_odd_texts(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(50, " ".join(base))]
    for k in range(51, 90):  # each is near the first, hardly any two are near each other
        own = list(base)
        for i in rng.sample(range(300), 4):
            own[i] = f"y{rng.randrange(5000)}"
        rows.append((k, " ".join(own)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one three"), (7, "a b c d e f g h"),
             (8, "a b c d e f g h i"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.classes(docs).collect()}
    texts = {k: t for k, t in rows}
    near = {k for k in range(50, 90) if jaccard(texts[50], texts[k]) >= 0.8}
    assert len(near) > 30 and {got[k] for k in near} == {50}
    assert (got[1], got[2], got[3]) == (1, 1, 1) and got[6] == 6
    assert got[4] == got[5] == 4 and got[7] == 7 and got[8] == 7
    assert near_copies.classes(docs.limit(0)).count() == 0
