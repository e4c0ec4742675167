"""Segments, tables of queries and rules, and the chunking fold, against plainer ways to the same rows."""

import random
from pathlib import Path

import pytest
from conftest import DATA, make_paper, papers_df
from pyspark.sql import functions as F

from quillspark.functions.chunking import fold_sections, section_chunks
from quillspark.operators import block_max, postings, query_table, ranking, routing, rule_table
from quillspark.operators.segments import SegmentedIndex
from quillspark.sources.tables import papers_from_documents

QUERY = "erou rest para"


@pytest.fixture(scope="module")
def papers(spark):
    table = papers_from_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    return table.persist()


def hits(found):
    return [(r.id, r.score) for r in found.orderBy(*ranking.rank_order()).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_without_a_shuffle(papers):
    assert "Exchange" not in plan(postings.postings(papers))


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_segments_rank_like_an_index_written_at_once(spark, papers, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path), buckets=4)
    few = papers.where(F.col("id").isin([r.id for r in papers.orderBy("id").limit(2).collect()]))
    ids = few.select("id")
    old = papers.withColumn("abstract", F.lit("para para rest"))
    first = index.add(papers.join(ids, "id", "left_anti").unionByName(old.join(ids, "id", "left_semi")))
    assert hits(postings.search(index.index(), QUERY)) != hits(ranking.search(papers, QUERY))
    before = files(tmp_path)
    second = index.add(few)
    after = files(tmp_path)
    assert all(after[p] == t for p, t in before.items())  # nothing that was there is written again
    assert {p.relative_to(tmp_path).parts[1] for p in set(after) - set(before)} == {second}
    assert spark.read.parquet(f"{tmp_path}/segments/{second}/docs").count() == 2
    for options in ({}, {"limit": None}, {"year": 2012}, {"include_missing": True}):
        assert hits(postings.search(index.index(), QUERY, **options)) == hits(ranking.search(papers, QUERY, **options))
    index.remove(ids)
    without = papers.join(ids, "id", "left_anti")
    assert hits(postings.search(index.index(), QUERY)) == hits(ranking.search(without, QUERY))
    # A removed paper comes back, and the older segments become one.
    index.add(few)
    merged = index.merge([first, second])
    assert merged == index.segments()[0] and len(index.segments()) == 3
    assert hits(postings.search(index.index(), QUERY)) == hits(ranking.search(papers, QUERY))
    index.merge()
    assert len(index.segments()) == 1
    assert hits(postings.search(index.index(), QUERY)) == hits(ranking.search(papers, QUERY))
    with pytest.raises(ValueError):
        index.merge([first])


def test_a_segment_that_another_writer_got_before_is_built_again(spark, tmp_path, monkeypatch):
    one, two = (papers_df(spark, make_paper(f"1712.0000{i}")).withColumn("in_latest_search", F.lit(True)) for i in (1, 2))
    index, rival = (SegmentedIndex(spark, str(tmp_path), buckets=2) for _ in range(2))
    plain, tries = index._replace, []

    def slow(ids, listed, folder):
        tries.append(len(listed))
        if len(tries) == 1:
            rival.add(two)
        plain(ids, listed, folder)

    monkeypatch.setattr(index, "_replace", slow)
    index.add(one)
    assert tries == [0, 1] and len(index.segments()) == 2
    assert {r.id for r in index.index().docs.collect()} == {"1712.00001", "1712.00002"}


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, papers, tmp_path):
    block_max.write_blocks(postings.stored_index(papers), str(tmp_path / "blocks"), size=4)
    index = block_max.read_blocks(spark, str(tmp_path / "blocks"))
    fewer = 0
    for query in (QUERY, "para", "rest", "nowordlikethis", "erou rest para the con"):
        for limit in (1, 3, 12, 500):
            assert hits(block_max.search(index, query, limit)) == hits(ranking.ranked(papers, query, limit)), (query, limit)
        if query != "nowordlikethis":
            read = sum(part.count() for part in block_max.wanted_blocks(index, query, 3))
            every = ranking.ranked(papers, query, None).count()
            assert read <= every
            fewer += read < every
    assert fewer >= 3


def test_a_table_of_queries_ranks_like_each_query(spark, papers):
    index = postings.stored_index(papers)
    queries = {1: QUERY, 2: "the of", 3: "para", 4: None, 5: "nowordlikethis", 6: "rest rest rests erou"}
    table = spark.createDataFrame(list(queries.items()), "q int, text string")
    ranked = query_table.rank_queries(index, table, "q", limit=5)
    assert "WindowGroupLimit" in plan(ranked)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.score))
    want = {}
    for q, text in queries.items():
        if q in (1, 3, 6):
            want[q] = [(i + 1, *h) for i, h in enumerate(hits(ranking.search(papers, text, limit=5)))]
    assert {q: sorted(rows) for q, rows in got.items()} == {q: rows for q, rows in want.items() if rows}
    blocks = query_table.query_blocks(ranked, papers, "q", max_chars=400).collect()
    assert {(r.q, r.id) for r in blocks} == {(q, h[1]) for q, rows in want.items() for h in rows}
    assert all(r.shown == (r.used <= 300) for r in blocks)


TERMS = ["graph", "graphs", "knowledge graph", "c++", ".net", "über-maß", "a", "owl", "x_y", "one two  three", "question-answering",
         "seven words in a row that is", "日本"]


def test_rules_as_a_table_route_like_patterns(spark):
    rng = random.Random(3)
    bits = [*TERMS, " ", ", ", "-", "s", "_", "é", ". ", "GRAPH", "Über-Maß", "(", "net", "日", "+"]
    papers = [make_paper(f"1712.{i:05d}", title="".join(rng.choices(bits, k=4)), abstract="".join(rng.choices(bits, k=rng.randrange(14))))
              for i in range(150)]
    papers += [make_paper("1712.90000", title="", abstract=""), make_paper("1712.90001", title=" .", abstract="... ")]
    rules = [(f"t{i}", f"T{i}", TERMS[i:i + 2]) for i in range(len(TERMS))]
    table = spark.createDataFrame([(i, t, term) for i, (t, _, terms) in enumerate(rules) for term in terms],
                                  "position int, topic string, term string")
    docs = papers_df(spark, *papers)
    got = {r.id: r.topics for r in rule_table.route(docs, table).collect()}
    assert got == {r.id: r.topics for r in routing.with_topics(docs, rules).collect()}
    none = rule_table.route(docs, table.limit(0)).collect()
    assert len(none) == len(papers) and all(r.topics == ["other"] for r in none)


def test_the_fold_cuts_like_the_loop(spark):
    rng = random.Random(7)
    documents = []
    for i in range(200):
        blocks = []
        for _ in range(rng.randrange(7)):
            words = ["w" * rng.randrange(1, rng.choice([6, 30])) for _ in range(rng.randrange(1, 40))]
            blocks.append((rng.choice("AB") + " | x", rng.choice(["", " "]) + "".join(w + rng.choice(" \n ") for w in words)))
        documents.append((i, blocks))
    table = spark.createDataFrame(documents, "id int, blocks array<struct<label: string, text: string>>")
    for most in (20, 61, 200):
        folded = table.select("id", fold_sections(F.col("blocks"), most).alias("chunks"))
        assert "Python" not in plan(folded)
        got = {r.id: [(c.sections[0], c.text) for c in r.chunks] for r in folded.collect()}
        want = {i: list(section_chunks(blocks, most)) for i, blocks in documents}
        assert got == want
    odd = spark.createDataFrame([(1, [("a", None), ("b", ""), ("c", "x")]), (2, [])], "id int, blocks array<struct<label: string, text: string>>")
    assert [[(c.sections[0], c.text) for c in r.chunks] for r in odd.select(fold_sections(F.col("blocks"), 9).alias("chunks")).collect()] == [
        [("c", "x")], []]


def test_queries_and_papers_meet_in_groups(spark, papers, monkeypatch):
    monkeypatch.setattr(query_table, "GROUP_PAPERS", 30)
    monkeypatch.setattr(query_table, "GROUP_QUERIES", 2)
    queries = {"a": QUERY, "b": "para", "c": None, "d": "rest la de para", "e": "de la"}
    table = spark.createDataFrame(list(queries.items()), "q string, text string")
    ranked = query_table.rank_queries(postings.stored_index(papers), table, "q", limit=7)
    assert "ObjectHashAggregate" not in plan(ranked)  # no row for each (query, paper, term)
    got = {}
    for r in ranked.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r["rank"], r.id, r.published, r.score))
    for q in "abde":
        best = ranking.ranked(papers, queries[q], 7).orderBy(*ranking.rank_order()).collect()
        assert got[q] == [(i, r.id, r.published, r.score) for i, r in enumerate(best, 1)]
    assert "c" not in got


def test_postings_do_not_repeat_what_docs_hold(papers):
    index = postings.stored_index(papers)
    assert set(index.postings.columns) == {"bucket", "term", "id", "tf", "in_title"}
    assert {"published", "doc_length", "topics", "year_month", "in_latest_search"} <= set(index.docs.columns)


def test_texts_of_one_row_group_are_dealt_out_before_they_are_worked_on(spark, papers, monkeypatch):
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one, seen = papers.coalesce(1), []
    counted = postings._weighted_words
    monkeypatch.setattr(postings, "_weighted_words", lambda p, c: seen.append(p.rdd.getNumPartitions()) or counted(p, c))
    postings.stored_index(one)
    assert seen == [shuffled] and shuffled > 1
    rules = spark.createDataFrame([(0, "t", "de la")], "position int, topic string, term string")
    assert "REPARTITION_BY_NUM" in plan(rule_table.route(one, rules))
