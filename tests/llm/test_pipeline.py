"""The pipeline against a plain version of each stage, on a small fixture with odd rows."""
from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from quillspark.llm import byte_network, queries, stages
from test_near_copies import shingles
from test_rules_shards_mix import brute_quotas
from test_substring_dedup import expected

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, "A text that has no key.", "en", "src0", 23),
         (902, "Row that comes twice in the table.", "en", "src3", 34), (902, "Row that comes twice in the table.", "en", "src3", 34)],
        docs.schema)
    docs.unionByName(odd).write.parquet(str(root / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(root / "labels.parquet"))
    return str(root)


def plain(rows, net):
    rows = [r for r in rows if net.scores([(r[1] or "").encode()])[0] >= queries.ACCEPT]
    # groups by steps between sets of five-word shingles with a Jaccard similarity of 0.8 or more
    sets = [frozenset(shingles(r[1])) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and 5 * both >= 4 * len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r)
    rows = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    cut = expected([((r[0], r[1]), r[1]) for r in rows], 35)
    by = {c[0]: c for c in cut}
    kept = []
    for r in rows:
        _, n, removed, text = by[r[0], r[1]]
        if removed and removed < n:
            kept.append((r[0], text, r[2], r[3], len(text)))
        elif not removed:
            kept.append(r)
    return kept


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = byte_network.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = plain([tuple(r) for r in docs.collect()], net)
    got = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, folder)
        assert got.columns == COLUMNS, name
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    mixed = stages.to_weights(spark, got, folder)
    assert mixed.columns == COLUMNS
    domain = lambda s: queries.DOMAINS[int((s or "src0")[3:]) % 4]
    tree = defaultdict(lambda: defaultdict(dict))
    words = {r: len((r[1] or "").encode().split()) for r in want}
    for r in want:
        leaf = tree[domain(r[3])][r[2]]
        leaf[r[3]] = leaf.get(r[3], 0) + stages.MIX["max_epochs"] * words[r]
    weights = {tuple(x for x in w[:3] if x is not None): w[3] for w in queries.MIX_WEIGHTS}
    quotas = brute_quotas(tree, weights, int(sum(words.values()) * stages.MIX["budget_share"]))
    counts = Counter(map(tuple, mixed.collect()))
    assert set(counts) <= set(want)
    for (d, lang, source), quota in quotas.items():
        own = [r for r in want if (domain(r[3]), r[2], r[3]) == (d, lang, source)]
        taken = sum(counts[r] * words[r] for r in own)
        assert quota <= taken <= quota + max(words[r] for r in own), (d, lang, source)
        times = [counts[r] for r in own]
        assert max(times) - min(times) <= 1


def test_run(spark, folder):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) > 100
    for r in rows:
        assert r.ids == library.encode(r.decoded) and r.n_tokens == len(r.ids)


def test_extra_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["score", "row", "rest", "copies", "kept_text", "n_words", "_hash", "time"]
    wide = docs.limit(40).selectExpr("*", *[f"'{n} of mine' AS `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n} of mine" for n in names), name
        assert stage(spark, wide.limit(0), folder).count() == 0
    assert stages.as_pieces(spark, docs.limit(0), folder).count() == 0
    last = stages.as_pieces(spark, wide.withColumns({"ids": F.lit(1), "decoded": F.lit(2)}), folder)
    assert last.columns == [c for c in wide.columns if c != "text"] + ["n_tokens", "ids", "decoded"]
    told = {(r.doc_id, r.decoded, r.score) for r in last.collect()}
    assert told == {(r.doc_id, r.text or "", "score of mine") for r in wide.collect()}
