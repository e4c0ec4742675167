import json
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from xml.etree import ElementTree

import pytest
from conftest import DATA, make_feed, make_paper, papers_df
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.config import Config, api_query, scan_identity, search_url
from quillspark.operators import merge
from quillspark.plans import sync
from quillspark.plans.library import Library, now, writer_lock
from quillspark.schema import CATALOG, PAPER_COLUMNS
from quillspark.sources.connector import FetchError
from quillspark.sources.feed import parse_feed
from quillspark.operators.lookup import lookup
from quillspark.session import materialise
from quillspark.sinks.catalog import CatalogStore, CommitConflict
from quillspark.sources.library import raw_page_stream
from quillspark.sources.tables import papers_from_documents
from quillspark.streaming.merge_stream import PageMerger, StreamMerger, _drain, latest_revisions, run_page_merge


def quiet(_):
    pass


def feed_tables(spark, *raws):
    rows = [(i, r.decode() if isinstance(r, bytes) else r) for i, r in enumerate(raws)]
    return parse_feed(spark.createDataFrame(rows, "offset int, raw string"))


def test_query_and_form_address(library):
    from urllib.parse import parse_qs, urlparse
    assert api_query(library.config) == (
        "all:ontology AND all:language AND all:model AND "
        "(cat:cs.* OR cat:econ.* OR cat:eess.* OR cat:math.* OR cat:stat.*)")
    form = parse_qs(urlparse(search_url(library.config)).query)
    assert form["terms-1-term"] == ["language model"]
    assert form["classification-include_cross_list"] == ["include"]
    assert "classification-physics" not in form
    quoted = Config(**{**vars(library.config), "terms": ['"exact phrase"'], "subjects": ["cs"]})
    assert api_query(quoted) == 'all:"exact phrase" AND (cat:cs.*)'
    assert len(scan_identity(library.config)) == 64


@pytest.mark.parametrize("change", [
    {"subjects": []}, {"subjects": ["physics"]}, {"terms": []}, {"terms": ["a;b"]}, {"page_size": 0},
    {"title_page_size": 51}, {"chunk_chars": 999}, {"api_delay_seconds": 2}, {"content_delay_seconds": 14},
    {"retries": 6}, {"timeout_seconds": 0}])
def test_config_limits(library, change):
    with pytest.raises(ValueError):
        Config(**{**vars(library.config), **change})


@pytest.fixture(scope="module")
def rows(spark):
    """Papers of the documents table as plain rows, those with a text only."""
    table = papers_from_documents(spark.read.parquet(f"{DATA}/documents.parquet"))
    found = table.orderBy("id").select(*PAPER_COLUMNS).limit(40).collect()
    return [p for p in (r.asDict() for r in found) if p["abstract"].strip() and p["title"].strip()]


def one_space(text):
    return " ".join(text.split())


def test_pages_of_the_table_come_back_as_they_went(spark, rows):
    """Odd texts travel through XML: what is read differs from the table by white space and the order of categories."""
    odd = [{**rows[0], "title": "5 < 6 && \"q\"", "abstract": "]]> &amp;\t\n  <b>not markup</b>"},
           {**rows[1], "authors": ["O'Neil & Søn", "李"], "categories": ["physics.geo-ph", "cs.DB", "physics.geo-ph"]}]
    want = odd + rows[2:9]
    pages, entries = feed_tables(spark, make_feed(want[:4], 9), make_feed(want[4:], 9, 4))
    assert [(r.total, r.start, r.n_papers, r.error) for r in pages.orderBy("offset").collect()] == [
        (9, 0, 4, None), (9, 4, 5, None)]
    got = entries.orderBy("offset", "position").collect()
    for r, p in zip(got, want, strict=True):
        assert (r.id, r.version, r.authors, r.primary_category) == (p["id"], p["version"], p["authors"], p["primary_category"])
        assert (r.title, r.abstract) == (one_space(p["title"]), one_space(p["abstract"]))
        assert r.categories == sorted(set(p["categories"])) and r.year_month == p["published"][:7]


def test_each_broken_page_is_told_from_the_others(spark, rows):
    good = make_feed(rows[:2]).decode()
    feed, entry = "{http://www.w3.org/2005/Atom}", rows[0]["abs_url"]
    no_version = entry[:entry.rindex("v")]

    def without(name):
        tree = ElementTree.fromstring(good)
        first = tree.find(f"{feed}entry")
        for child in [c for c in first if c.tag.endswith(name)]:
            first.remove(child)
        return ElementTree.tostring(tree).decode()

    broken = {
        "cut short": good[:len(good) // 2], "two roots": good + good, "no XML": json.dumps({"entries": []}),
        "other root": good.replace("feed", "list"), "bare ampersand": good.replace("Desk ", "Desk & "),
        "no version": good.replace(entry, no_version), "no number": good.replace(">2<", "><", 1),
        "error entry": good.replace(entry, "http://arxiv.org/api/errors#17"),
        "bad time": good.replace(rows[0]["published"], "2012-19-40T00:00:00Z"),
        **{f"without {n}": without(n) for n in ("title", "summary", "published", "updated", "category")}}
    pages, entries = feed_tables(spark, *broken.values(), good)
    told = {r.offset: r.error for r in pages.collect()}
    assert {name for i, name in enumerate(broken) if told[i] is None} == set() and told[len(broken)] is None
    assert entries.select("offset").distinct().collect() == [(len(broken),)]


def plain_merge(stored, scan, stamp):
    """The merge on dictionaries: id to (version, updated, content, first seen, last seen, current)."""
    counts, out = Counter(), {}
    for key in stored.keys() | scan.keys():
        old, new = stored.get(key), scan.get(key)
        if new is None:
            counts["not_in_latest_search"] += 1
            out[key] = (*old[:5], False)
        elif old is None:
            counts["added"] += 1
            out[key] = (*new, stamp, stamp, True)
        else:
            stale = new[:2] < old[:2]
            counts["unchanged" if stale or new == old[:3] else "updated"] += 1
            out[key] = (*(old[:3] if stale else new), old[3], stamp, True)
    return out, counts


def test_a_series_of_scans_equals_a_plain_merge(spark, rows):
    rng, stored, model = random.Random(11), spark.createDataFrame([], CATALOG), {}
    base = rows[:25]
    for turn in range(4):
        scan = []
        for p in rng.sample(base, 18):
            version = max(1, p["version"] + rng.randrange(-1, 3))
            scan.append({**p, "version": version, "comment": rng.choice(["", "", "second"]),
                         "updated": f"2015-0{version}-0{rng.randrange(1, 4)}T00:00:00Z"})
        stamp = f"scan {turn}"
        merged = materialise(merge.merge(stored, papers_df(spark, *scan), stamp))
        counts = merge.merge_counts(merged).first().asDict()
        stored = merged.drop("state").select(*CATALOG.names)
        model, told = plain_merge(model, {p["id"]: (p["version"], p["updated"], p["comment"]) for p in scan}, stamp)
        assert counts == {name: told[name] for name in merge.COUNTED_STATES}
        assert {r.id: (r.version, r.updated, r.comment, r.first_seen, r.last_seen, r.in_latest_search)
                for r in stored.collect()} == model


def test_copies_in_one_scan_are_judged_in_their_order(spark, rows):
    own = {**rows[0], "version": 5}
    stored = merge.merge(spark.createDataFrame([], CATALOG), papers_df(spark, own), "a").drop("state").select(*CATALOG.names)
    versions = [6, 9, 4, 7, 5]  # the last that is not older than the stored one counts: 5, with other content
    scan = papers_df(spark, *[{**own, "version": v, "comment": f"copy {v}"} for v in versions]).withColumn(
        "turn", F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(versions) for x in (v, i)]), F.col("version")))
    merged, states = merge.merge_with_repeats(stored, scan, "b", "turn")
    assert [(r.version, r.comment) for r in merged.collect()] == [(5, "copy 5")]
    assert merge.merge_counts(states).first().asDict() == {
        "added": 0, "updated": 4, "unchanged": 1, "not_in_latest_search": 0}


class Archive:
    """Answers any page of a list of papers. faults: what happens instead at the n-th request."""

    def __init__(self, papers, size, **faults):
        self.papers, self.size, self.faults, self.starts = papers, size, {int(k[1:]): v for k, v in faults.items()}, []

    def get(self, url, content=False):
        start = int(re.search(r"[?&]start=(\d+)", url).group(1))
        self.starts.append(start)
        page, total, told = self.papers[start:start + self.size], len(self.papers), start
        match self.faults.get(len(self.starts)):
            case "offline":
                raise FetchError("no answer")
            case "grown":
                total += 1
            case "empty":
                page = []
            case "shifted":
                told = start + 1
            case "repeats":
                page = [self.papers[0], *page[1:]]
            case "stray":
                page = [{**page[0], "categories": ["econ.GN"], "primary_category": "econ.GN"}, *page[1:]]
            case "endless":
                total = 30_001
        return make_feed(page, total, told)


@pytest.fixture
def five(library):
    return Library(library.spark, library.root, Config(**{**vars(library.config), "page_size": 5, "subjects": ["cs", "math"]}))


def contents(library):
    return {(r.id, r.version, r.in_latest_search) for r in library.store.papers().collect()}


def test_a_scan_that_breaks_off_goes_on_to_the_same_catalog(five, rows):
    papers = rows[:13]
    broken = Archive(papers, 5, n2="offline")
    with pytest.raises(FetchError):
        sync.update(five, broken, progress=quiet)
    assert five.store.latest() is None and broken.starts == [0, 5]
    resumed = Archive(papers, 5)
    report = sync.update(five, resumed, progress=quiet)
    assert resumed.starts == [5, 10] and not five.progress_path.exists()
    assert (report["added"], report["total_stored"], report["total_results"]) == (13, 13, 13)
    assert contents(five) == {(p["id"], p["version"], True) for p in papers}
    # Two papers leave the search, one is revised; the generation before is the backup.
    version = papers[0]["version"] + 1
    address = f"{papers[0]['abs_url'].rsplit('v', 1)[0]}v{version}"
    after = [{**papers[0], "version": version, "abs_url": address}, *papers[1:11]]
    report = sync.update(five, Archive(after, 5), progress=quiet)
    assert [report[n] for n in merge.COUNTED_STATES] == [0, 1, 10, 2]
    assert {k for k, _, current in contents(five) if not current} == {p["id"] for p in papers[11:]}
    assert five.store.previous().where("in_latest_search").count() == 13
    assert [r.added for r in five.store.runs().collect()] == [13, 0]


@pytest.mark.parametrize("fault, told", [("grown", "changed"), ("empty", "empty"), ("shifted", "Unexpected"), ("repeats", "Duplicate"),
                                         ("stray", "out-of-scope"), ("endless", "window")])
def test_a_fault_in_a_later_page_leaves_the_catalog_alone(five, rows, fault, told):
    with pytest.raises(ValueError, match=told):
        sync.update(five, Archive(rows[:8], 5, n2=fault), progress=quiet)
    assert five.store.latest() is None
    if fault == "grown":  # from the start again, nothing of the bad scan is left
        assert sync.update(five, Archive(rows[:8], 5), restart=True, progress=quiet)["added"] == 8


@pytest.mark.parametrize("change, usable", [({}, True), ({"started_at": "2011-01-01T00:00:00+00:00"}, False), ({"identity": "x"}, False)])
def test_only_recent_progress_of_the_same_query_is_used(five, change, usable):
    five.progress_path.parent.mkdir(parents=True, exist_ok=True)
    saved = {"identity": scan_identity(five.config), "started_at": now(), "next_start": 5, "total": 8, **change}
    five.progress_path.write_text(json.dumps(saved))
    assert (sync._resumable(five, restart=False) == saved) is usable
    assert sync._resumable(five, restart=True) is None


def test_another_query_is_refused_and_no_result_marks_all_gone(five, rows):
    sync.update(five, Archive(rows[:3], 5), progress=quiet)
    other = Library(five.spark, five.root, Config(**{**vars(five.config), "subjects": ["cs"]}))
    with pytest.raises(ValueError, match="criteria changed"):
        sync.update(other, Archive([], 5), progress=quiet)
    assert sync.update(five, Archive([], 5), progress=quiet)["not_in_latest_search"] == 3


def test_a_commit_that_another_writer_got_before_is_merged_again(spark, rows, tmp_path):
    """Two writers build on the same generation; the second one's commit is refused, and nothing of either is lost."""
    store, rival = (CatalogStore(spark, f"{tmp_path}/catalog") for _ in range(2))
    tries = []

    def slow(papers):
        tries.append(papers.count())
        if len(tries) == 1:
            rival.change(lambda found: merge.merge(found, papers_df(spark, rows[1]), "rival", partial=True).drop("state"))
        return merge.merge(papers, papers_df(spark, rows[0]), "slow", partial=True).drop("state")

    store.change(slow)
    assert tries == [0, 1] and store.generation() == 2
    assert {r.id for r in store.papers().collect()} == {rows[0]["id"], rows[1]["id"]}
    with pytest.raises(CommitConflict):
        store.commit(2, "any")
    assert store.generation() == 2 and [r.generation for r in store.commits().orderBy("generation").collect()] == [1, 2]


def test_two_threads_lose_no_commit(spark, rows, tmp_path):
    def add(p):
        CatalogStore(spark, f"{tmp_path}/catalog").change(
            lambda found: merge.merge(found, papers_df(spark, p), "t", partial=True).drop("state"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, rows[:6]))
    store = CatalogStore(spark, f"{tmp_path}/catalog")
    assert store.generation() == 6 and {r.id for r in store.papers().collect()} == {p["id"] for p in rows[:6]}


def test_a_batch_leaves_the_flag_of_rows_it_does_not_mention(spark, rows, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/state/catalog")
    store.change(lambda _: papers_df(spark, *rows[:2]).withColumns(
        {"first_seen": F.lit("s"), "last_seen": F.lit("s"), "in_latest_search": F.col("id") == rows[1]["id"]}))
    landed(tmp_path / "land", 0, rows[2])
    got = {r.id: r.in_latest_search for r in run_page_merge(spark, f"{tmp_path}/land", f"{tmp_path}/state").collect()}
    assert got == {rows[0]["id"]: False, rows[1]["id"]: True, rows[2]["id"]: True}


def test_equal_revisions_in_a_batch_give_the_same_row_in_any_order(spark, rows):
    copies = papers_df(spark, *[{**rows[0], "comment": c} for c in "abcdef"])
    chosen = {latest_revisions(copies.orderBy(F.rand(i)).repartition(i)).first().comment for i in range(1, 5)}
    assert len(chosen) == 1


def test_lock_excludes_a_second_writer(tmp_path):
    with writer_lock(tmp_path):
        with pytest.raises(RuntimeError):
            with writer_lock(tmp_path):
                pass
    with writer_lock(tmp_path):
        pass


def landed(folder, offset, *papers):
    folder.mkdir(exist_ok=True)
    (folder / f"{offset:06d}.xml").write_bytes(make_feed(list(papers)))


def test_stream_merges_pages_as_they_land_and_ignores_late_revisions(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "state")
    landed(land, 0, make_paper(version=2), make_paper("1712.03412"))
    first = run_page_merge(spark, str(land), root)
    assert {(r.id, r.version) for r in first.collect()} == {("1712.03411", 2), ("1712.03412", 1)}
    landed(land, 2, make_paper(version=1), make_paper("1712.03412", version=3))
    second = run_page_merge(spark, str(land), root)
    assert {(r.id, r.version) for r in second.collect()} == {("1712.03411", 2), ("1712.03412", 3)}
    assert all(r.first_seen == "batch 00000000" for r in second.collect())
    unchanged = run_page_merge(spark, str(land), root)
    assert unchanged.count() == 2 and set(PAPER_COLUMNS) <= set(unchanged.columns)


def test_stream_with_a_new_checkpoint_loses_nothing(spark, tmp_path):
    store = CatalogStore(spark, f"{tmp_path}/state/catalog")
    for offset in (0, 2):
        landed(tmp_path / "land", offset, make_paper(f"1712.0341{offset + 1}"))
        run_page_merge(spark, f"{tmp_path}/land", f"{tmp_path}/state")
    assert store.generation() == 2
    # Another stream (a checkpoint of its own) with one batch, into the same catalog.
    landed(tmp_path / "other", 0, make_paper("1712.03419"))
    merger = StreamMerger(store, f"{tmp_path}/lost/checkpoint")
    _drain(raw_page_stream(spark, f"{tmp_path}/other"), PageMerger(merger, f"{tmp_path}/lost/bad"), merger.checkpoint)
    assert {r.id for r in store.papers().collect()} == {"1712.03411", "1712.03413", "1712.03419"}
    # The same batch once more changes nothing.
    before = store.generation()
    merger(store.papers().drop("first_seen", "last_seen", "in_latest_search"), 0)
    assert store.generation() == before


def test_a_bad_page_stops_the_stream_and_is_kept(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "state")
    landed(land, 0, make_paper(), make_paper("1712.03412", title=""))
    with pytest.raises(StreamingQueryException, match="not usable"):
        run_page_merge(spark, str(land), root)
    bad = spark.read.json(f"{root}/bad_pages").collect()
    assert [(r.offset, r.error) for r in bad] == [(0, "Incomplete metadata for 1712.03412")]
    landed(land, 0, make_paper(), make_paper("1712.03412", title="Now complete"))
    assert run_page_merge(spark, str(land), root).count() == 2


def test_stored_columns_that_a_scan_lacks_stay(spark):
    stored = papers_df(spark, make_paper(version=3), make_paper("1712.03412"), make_paper("1712.03413")).selectExpr(
        "*", "'mine' AS extra", "'t0' AS first_seen", "'t0' AS last_seen", "true AS in_latest_search")
    scan = papers_df(spark, make_paper(version=2), make_paper("1712.03412", version=2))
    for merged in (merge.merge(stored, scan, "t1"),
                   merge.merge(stored, scan.withColumn("position", F.lit(1)), "t1", repeats="position")):
        assert {(r.id, r.version, r.extra) for r in merged.collect()} == {
            ("1712.03411", 3, "mine"), ("1712.03412", 2, None), ("1712.03413", 1, "mine")}


def test_lookup_keeps_positions_and_odd_values(spark):
    wanted = spark.createDataFrame([(0, "no id"), (1, "1712.03412V1"), (2, None), (3, "1712.03412"), (4, "1712.99999")],
                                   "position int, value string")
    rows = lookup(papers_df(spark, make_paper("1712.03412")).select("id", "version", "title"), wanted).collect()
    assert sorted((r.position, r.problem) for r in rows) == [
        (0, "invalid identifier"), (1, None), (2, "invalid identifier"), (3, None), (4, "not in this catalog")]
