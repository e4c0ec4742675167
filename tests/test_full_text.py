import random
import sys

import pytest
from conftest import ScriptedClient, make_feed, make_paper
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions.chunking import chunk_blocks, chunk_text, section_chunks
from quillspark.functions.html import article_blocks
from quillspark.functions.pdf import pdf_blocks
from quillspark.operators import fulltext
from quillspark.plans import fetch as fetch_plan, sync
from quillspark.sources import library as files
from quillspark.sources.connector import FetchError

TEXT = st.text(alphabet="ab \n é", max_size=120)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), TEXT), max_size=8), st.integers(8, 40))
def test_chunks_respect_the_ceiling_and_lose_no_text(blocks, limit):
    chunks = list(section_chunks(blocks, limit))
    assert all(0 < len(text) <= limit for _, text in chunks)
    for label in "AB":
        kept = "".join("".join(t.split()) for s, t in chunks if s == label)
        assert kept == "".join("".join(t.split()) for s, t in blocks if s == label)


def test_giant_unbroken_text():
    chunks = list(section_chunks([("Intro", "word " * 900), ("Methods", "x" * 5200)], 1000))
    assert all(len(t) <= 1000 for _, t in chunks)
    assert sum(t.count("x") for _, t in chunks) == 5200
    assert {s for s, _ in chunks} == {"Intro", "Methods"}


def test_blocks_fill_the_room_that_is_left():
    assert list(section_chunks([("S", "a" * 6), ("S", "bbb ccc ddd"), ("S", "")], 12)) == [
        ("S", "a" * 6 + "\n\nbbb"), ("S", "ccc ddd")]


def test_native_and_block_chunkers_agree(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc \n 　é🙂") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    native = {r.i: r.c for r in rows.select("i", chunk_text(F.col("t"), 50).alias("c")).collect()}
    assert native == {i: [c for _, c in section_chunks([("L", t)], 50)] for i, t in enumerate(texts)}
    blocks = spark.createDataFrame([([("L", t)],) for t in texts], f"b {schema.BLOCKS.simpleString()}")
    cut = [[c.text for c in r.c] for r in blocks.select(chunk_blocks(F.col("b"), 50).alias("c")).collect()]
    assert sorted(cut) == sorted(native.values())


def test_html_keeps_math_tables_and_sections_without_scripts():
    body = "Detailed content. " * 40
    blocks = article_blocks(
        f'<article><p>wrong</p></article><article class="x ltx_document"><h1>Title</h1><nav>menu</nav>'
        f'<div>loose &amp; text<b>bold</b></div><h2>Methods <i>part</i></h2><p>{body}</p>'
        '<p><math alttext="x^2"><mi>x</mi></math> and <math><mi>y</mi><mo>+</mo></math></p>'
        '<script>bad()</script><table><tr><td>a</td><th>b|c</th></tr><tr><td>d</td></tr></table>'
        '<figure><img alt="a plot"><img></figure><div class="ltx_equation">E = m</div>'
        '<!-- remark --><ul><li>one<li>two</ul></article>')
    assert blocks == [
        ("Title", "# Title"), ("Title", "loose & text"), ("Title", "bold"),
        ("Methods part", "## Methods part"), ("Methods part", body.strip()),
        ("Methods part", "$x^2$ and $y +$"), ("Methods part", "a | b|c\nd"),
        ("Methods part", "[Figure image: a plot]"), ("Methods part", "[Figure image: see original]"),
        ("Methods part", "E = m"), ("Methods part", "remark"), ("Methods part", "one two")]


@pytest.mark.parametrize("markup", ["<html><p>no article</p></html>", "<article><p>short</p></article>", ""])
def test_unusable_html_is_refused(markup):
    with pytest.raises(ValueError):
        article_blocks(markup)


def test_pdf_pages_and_their_warnings():
    pages = ["word " * 30, "tiny", "more " * 30]
    blocks, warnings = pdf_blocks(b"%PDF-1", lambda _: pages)
    assert [label for label, _ in blocks] == ["PDF page 1", "PDF page 2", "PDF page 3"]
    assert blocks[0][1].startswith("## PDF page 1\n\nword") and blocks[1][1].endswith("\ntiny")
    assert warnings[1].endswith(": 2")
    for body, read in ((b"html", None), (b"%PDF-", lambda _: ["", "x"]), (b"%PDF-", lambda _: [])):
        with pytest.raises(ValueError):
            pdf_blocks(body, read)
    def broken(_):
        raise KeyError("damaged")
    with pytest.raises(ValueError, match="extraction failed"):
        pdf_blocks(b"%PDF-", broken)


def article(text="Research content. "):
    return f"<article><h1>Test | paper</h1><p>{text * 500}</p></article>".encode()


@pytest.fixture
def stocked(library):
    papers = [make_paper(), make_paper("cs/9901001")]
    sync.update(library, ScriptedClient(make_feed(papers)), progress=lambda _: None)
    return library


def fetch(library, client, ids, preferred="html", **options):
    papers = fetch_plan.choose(library, ids, everything=not ids)
    return fetch_plan.fetch(
        library, client, papers, preferred, progress=lambda _: None, ids=ids, **options)


def is_valid(library, paper):
    row = fetch_plan.cache_states(library).where(F.col("id") == paper).first()
    return bool(row and row.valid)


def test_cache_survives_damage_without_a_second_download(stocked):
    client = ScriptedClient(article())
    assert fetch(stocked, client, ["cs/9901001"]).cached == ["cs/9901001"]
    assert [tuple(r) for r in files.cached_versions(stocked.spark, str(stocked.root)).collect()] == [("cs/9901001", 1)]
    folder = stocked.root / "papers/cs_9901001/cs_9901001v1"
    assert is_valid(stocked, "cs/9901001") and (folder / "original.html").read_bytes() == article()
    assert fetch(stocked, client, ["cs/9901001"]).cached == [] and len(client.urls) == 1
    contents = fetch_plan.read(stocked, "cs/9901001")
    assert "| [0001](chunks/0001.md) | Test &#124; paper | " in contents
    first = fetch_plan.read(stocked, "cs/9901001v1", 1, 500)
    assert len(first) <= 500 and first.startswith("Source: https://arxiv.org/html/cs/9901001v1\nChunk: 1\n")
    with pytest.raises(ValueError, match="between 1 and 2"):
        fetch_plan.read(stocked, "cs/9901001", 3)
    (folder / "chunks/0001.md").write_text("corrupt")
    assert not is_valid(stocked, "cs/9901001")
    with pytest.raises(ValueError, match="corrupt"):
        fetch_plan.read(stocked, "cs/9901001", 1)
    fetch(stocked, client, ["cs/9901001"])
    assert is_valid(stocked, "cs/9901001") and len(client.urls) == 1
    assert fetch_plan.read(stocked, "cs/9901001", 2)
    with pytest.raises(ValueError, match="not cached"):
        fetch_plan.read(stocked, "1712.03411")


def test_new_version_has_no_cache(stocked):
    fetch(stocked, ScriptedClient(article()), ["1712.03411"])
    newer = [make_paper(version=2), make_paper("cs/9901001")]
    sync.update(stocked, ScriptedClient(make_feed(newer)), progress=lambda _: None)
    with pytest.raises(ValueError, match="not cached"):
        fetch_plan.read(stocked, "1712.03411")
    with pytest.raises(ValueError, match="v2"):
        fetch_plan.read(stocked, "1712.03411v1")


def fake_pdf_udf(column):
    return F.struct(
        F.array(F.struct(F.lit("PDF page 1").alias("label"), F.lit("full text " * 100).alias("text"))).alias("blocks"),
        F.array(F.lit("pdf note")).alias("warnings"), F.lit(None).cast("string").alias("error"))


def test_missing_html_falls_back_to_pdf_but_denial_stops(stocked):
    client = ScriptedClient(FetchError("gone", 404), b"<article>too short</article>", b"%PDF-one", b"%PDF-two")
    outcome = fetch(stocked, client, [], "auto", pdf_udf=fake_pdf_udf)
    assert sorted(outcome.cached) == ["1712.03411", "cs/9901001"] and not outcome.failures
    rows = files.manifests(stocked.spark, str(stocked.root)).collect()
    assert {r.manifest.format for r in rows} == {"pdf"}
    assert all("PDF fallback used" in r.manifest.warnings[0] for r in rows)
    assert len(client.urls) == 4 and not list(stocked.root.glob("papers/*/*/.incoming*"))


def test_denial_stops_further_requests_and_other_errors_do_not(stocked):
    client = ScriptedClient(FetchError("denied", 403), article())
    with pytest.raises(FetchError):
        fetch(stocked, client, [], "auto")
    assert len(client.urls) == 1
    outcome = fetch(stocked, ScriptedClient(FetchError("broken", 500), article()), [], "auto")
    assert list(outcome.failures) == ["1712.03411"] and outcome.cached == ["cs/9901001"]
    with pytest.raises(ValueError):
        fetch_plan.choose(stocked, ["1712.99999"], False)


def test_pdf_reader_is_optional(stocked):
    if "pypdf" in sys.modules:
        pytest.skip("pypdf is installed")
    outcome = fetch(stocked, ScriptedClient(b"%PDF-x", b"no pdf"), [], "pdf")
    assert set(outcome.failures) == {"1712.03411", "cs/9901001"}
    assert (stocked.root / "papers/1712.03411/1712.03411v1/original.pdf").exists()


def test_empty_documents_are_never_valid(spark):
    rows = spark.createDataFrame(
        [("x", 1, "page", ("x", 1, "", "", "", [], "", []))],
        "id string, version int, contents string, manifest " + files.MANIFEST.simpleString())
    nothing = spark.createDataFrame([], "id string, version int, path string, body string")
    assert fulltext.cache_state(rows, nothing).first().valid is False
