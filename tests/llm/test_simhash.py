"""SimHash near-dedup against comparing all fingerprints."""
from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from quillspark.llm import components, simhash
from quillspark.session import materialise


def brute_print(text, shingle=3):
    data = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    own = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bits = np.array(values, np.int64).view(np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2):
            a, b = sorted((find(int(v)), find(int(values[j]))))
            root[b] = a
    return {v: find(v) for v in root}


@pytest.mark.parametrize("paired", [1, 64])
def test_links_join_all_that_two_bits_join(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = np.random.default_rng(paired)
    values = set()
    for centre in rng.integers(0, 2 ** 63, 2):
        for _ in range(80):
            v = int(centre)
            for bit in rng.integers(0, 63, rng.integers(0, 6)):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    table = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = {r.node: r.root for r in components.components(simhash.links(table)).collect()}
    assert {v: got.get(v, v) for v in values} == brute_roots(values)


@pytest.mark.parametrize("paired", [1, 64])
def test_links_broadcast_nothing(spark, monkeypatch, paired):
    """The rows of an explode count as few as what is exploded, so a broadcast of them can end the driver."""
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    plans = []

    def ran(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(simhash, "materialise", lambda df: ran(df) and materialise(df))
    table = materialise(spark.createDataFrame([(v << 32 | v,) for v in range(300)], "fp bigint"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10_000_000
    found = ran(simhash.links(table))
    assert {(r.a, r.b) for r in found} >= {(0, 1 << 32 | 1), (0, 2 << 32 | 2)}
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_classes_broadcast_no_table_of_all_rows(spark):
    table = spark.createDataFrame([(k, f"w{k % 50} one two three") for k in range(100)], "doc_id bigint, text string")
    got = simhash.near_classes(table)
    assert sorted(r.component_id for r in got.collect()) == sorted(k % 50 for k in range(100))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_long_path_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (None, 3), (500, 400)], "a int, b int")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 400, 400: 400}
    assert components.components(links.limit(0)).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    links = spark.createDataFrame([(i % 3, i) for i in range(3, 60)] + [(3, 0)], "a int, b int")
    written = []
    monkeypatch.setattr(components, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: i % 3 for i in range(60)} and len(written) == 1


def test_a_round_of_few_links_is_written_by_few_tasks(spark, monkeypatch):
    """The tables of rounds lie in as many files as their rows are worth, however many partitions a shuffle has."""
    settings = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    written = []
    monkeypatch.setattr(components, "materialise", lambda df: written.append(materialise(df)) or written[-1])
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a int, b int")
        assert {r.root for r in components.components(links).collect()} == {0}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    most = 2 * spark.sparkContext.defaultParallelism
    assert len(written) > 2 and max(len(t.inputFiles()) for t in written[1:]) <= most


def test_classes_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "A b C d"), (3, "a B c D"), (9, None), (8, ""), (7, "one two"), (7, "one two"), (None, "one two"),
            (20, long), (21, long.replace("w7 ", "v7 ")), (22, "È é è"), (23, "è é è")]
    table = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, fingerprint int")
    got = simhash.near_classes(table).collect()
    assert sorted((r.doc_id, r.fingerprint % 2 ** 64) for r in got if r.doc_id is not None) == sorted(
        (k, brute_print(t)) for k, t in rows if k is not None)
    least = {}
    prints = {k: brute_print(t) for k, t in rows if k is not None}
    signed = {k: int(np.uint64(p).astype(np.int64)) for k, p in prints.items()}
    roots = brute_roots(sorted(set(signed.values())))
    for k in prints:
        r = roots[signed[k]]
        least[r] = min(least.get(r, k), k)
    assert all(r.component_id == least[roots[signed[r.doc_id]]] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [7]
    assert simhash.near_classes(table.limit(0)).count() == 0
