"""Weak rules, sharding and mixing against plain Python."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

from conftest import DATA

from quillspark.llm import mixing, sharding, weak_rules

TEXTS = [None, "", " \n ", "a", "a b c a b c a b c", "# $ % a|b\nline\n\nline\nLINE\n \n", "x y z " * 40,
         "ÄÖÜ É! wow !! Ab cd \x1c e", "one\ttwo\x0bthree\rfour", "aa bb cc dd aa bb cc ee bb cc dd", "word " * 3000]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_base_counts(spark):
    table = spark.createDataFrame([(i, t, 1, "v") for i, t in enumerate(TEXTS)],
                                  "doc_id bigint, text string, n_words int, _words string")
    got = {r.doc_id: tuple(r)[1:6] for r in weak_rules.base_features(table).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}
    verdicts = weak_rules.judged(table).collect()
    assert len(verdicts) == len(TEXTS)
    for r in verdicts:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept) and 0 <= r.p_good <= 1
    assert weak_rules.judged(table.limit(0)).count() == 0


def test_fit_finds_the_poor_rule(spark):
    votes = [(1, 1, -1)] * 40 + [(-1, -1, 1)] * 10 + [(1, 1, 1)] * 40 + [(-1, -1, -1)] * 10
    right = weak_rules.fitted(spark.createDataFrame(votes, "a int, b int, c int"), ["a", "b", "c"])
    assert right["a"] > 0.95 and right["b"] > 0.95 and right["c"] < 0.65


def test_rules_agree_with_the_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = weak_rules.judged(docs).filter("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def brute_shard(key, weights):
    best = []
    for n, w in enumerate(weights):
        digits = hashlib.md5(f"{'null' if key is None else key}:{n}".encode()).hexdigest()[:15]
        best.append((-w / math.log((int(digits, 16) + 0.5) / 2 ** 60), -n))
    return -max(best)[1]


def test_shards(spark):
    keys = [*range(300), None, None, 7]
    table = spark.createDataFrame([(k, f"text {k}" if i % 9 else None, 5) for i, k in enumerate(keys)],
                                  "doc_id bigint, text string, shard int")
    got = sharding.shard_table(table, [1.0, 2.0, 1.0], 1.0).collect()
    assert len(got) == len(keys)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == brute_shard(r.doc_id, [1, 2, 1])
        assert r.grown_shard == brute_shard(r.doc_id, [1, 2, 1, 1]) and r.grown_shard in (r.shard, 3)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = {r.doc_id: r for r in got}
    assert (by_key[8].size, by_key[8].text_crc32) == (14, crc32(b"text 8"))
    assert (by_key[9].size, by_key[9].text_crc32) == (8, 0)
    share = Counter(r.shard for r in got)
    assert share[1] > share[0] and share[1] > share[2]
    assert sharding.shard_table(table.limit(0), [1.0]).count() == 0


def brute_quotas(tree, weights, budget):
    """tree: nested dicts down to capacities. Raises a common level until the budget is used up."""
    def capacity(node):
        return node if isinstance(node, int) else sum(capacity(c) if w(p) > 0 else 0 for p, c, w in items(node))

    def items(node):
        return [(k, c, lambda k: weights.get(k, 1)) for k, c in node.items()]

    def split(node, given, path, out):
        if isinstance(node, int):
            out[path] = given
            return
        caps = {k: capacity(c) if weights.get((*path, k), 1) > 0 else 0 for k, c in node.items()}
        full, left = {}, given
        while True:
            open_ = [k for k in caps if k not in full]
            total = sum(max(weights.get((*path, k), 1), 1) for k in open_)
            over = [k for k in open_ if Fraction(left * max(weights.get((*path, k), 1), 1), total) >= caps[k]]
            if not over:
                break
            for k in over:
                full[k] = caps[k]
            left = given - sum(full.values())
            if len(full) == len(caps):
                break
        for k, child in node.items():
            own = full[k] if k in full else left * max(weights.get((*path, k), 1), 1) // total
            split(child, own, (*path, k), out)

    out = {}
    split(tree, budget, (), out)
    return out


def test_budgets_go_to_siblings_first(spark):
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 300, ("b", None): 50, ("c", "x"): 0, ("d", "z"): 70}
    weights = {("a",): 5, ("b",): 2, ("a", "x"): 3, ("d",): 0}
    supply = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "p string, q string, tokens bigint")
    rows = [(k[0], k[1] if len(k) > 1 else None, w) for k, w in weights.items()]
    table = spark.createDataFrame(rows, "p string, q string, weight bigint")
    tree = defaultdict(dict)
    for (p, q), n in tokens.items():
        tree[p][q] = 2 * n if p != "d" else 0
    for budget in (0, 1, 90, 700, 2000, 10_000):
        got = {(r.p, r.q): r.quota for r in mixing.budgets(supply, table, ["p", "q"], budget, 2).collect()}
        assert got == brute_quotas(tree, weights, budget), budget


def test_copies_are_a_prefix_of_seeded_epochs(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"s{i % 2}", 3) for i in range(120)] + [
        (5, "w w", "en", "s1", 3), (5, "w w", "en", "s1", 3), (None, "w w w", "en", "s0", 3), (300, None, "en", "s0", 3)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, quota int")
    none = spark.createDataFrame([], "lang string, source string, weight bigint")
    got = mixing.mixed_rows(table, none, ["lang", "source"], budget=500, max_epochs=3, seed=4).collect()
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for r in got:
        leaves[r.lang, r.source].append(r)
    assert sum(v[0].quota for v in leaves.values()) in range(490, 501)
    for own in leaves.values():
        supply, quota = sum(r.n_tokens for r in own), own[0].quota
        full = quota // supply

        def place(r):
            name = f"4:{full}:{'null' if r.doc_id is None else r.doc_id}"
            return int(hashlib.md5(name.encode()).hexdigest()[:15], 16), r.doc_id or -1, r.n_tokens

        before = 0
        for r in sorted(own, key=place):
            assert r.copies == full + (before < quota - full * supply)
            before += r.n_tokens
    empty = mixing.mixed_rows(table.limit(0), none, ["lang", "source"], budget=5)
    assert empty.count() == 0
