from __future__ import annotations

import json
import os
import sys
from pathlib import Path
from xml.etree import ElementTree

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillspark.plans.library import Library  # noqa: E402
from quillspark.schema import PAPER  # noqa: E402
from quillspark.session import local_session, ship_package  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONFIG = {
    "terms": ["ontology", "language model"], "subjects": ["cs", "econ", "eess", "math", "stat"],
    "page_size": 2, "api_delay_seconds": 3.1, "content_delay_seconds": 15.1, "timeout_seconds": 60,
    "retries": 3, "user_agent": "paper-library-tests/1.0", "title_page_size": 2, "chunk_chars": 6000}


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    return Library.open(spark, tmp_path)


def make_paper(number="1712.03411", version=1, title="Ontology matching with large models",
               abstract="We study ontology matching and entity linking.", **changes):
    """A catalog row with every field; ``changes`` overrides any of them."""
    row = dict.fromkeys(PAPER.names, "")
    row.update(id=number, version=version, title=title, abstract=abstract, authors=["Mira Sol"],
               categories=["cs.DB", "stat.CO"], primary_category="cs.DB",
               published="2017-12-04T00:00:00Z", updated=f"2017-12-{version + 3:02d}T00:00:00Z", year_month="2017-12")
    for kind in ("abs", "pdf"):
        row[f"{kind}_url"] = f"https://arxiv.org/{kind}/{number}v{version}"
    return {**row, **changes}


def papers_df(spark, *papers):
    return spark.createDataFrame([tuple(p[f] for f in PAPER.names) for p in papers], PAPER)


ATOM, SEARCH, EXTRA = ("http://www.w3.org/2005/Atom", "http://a9.com/-/spec/opensearch/1.1/",
                       "http://arxiv.org/schemas/atom")
for prefix, space in (("", ATOM), ("o", SEARCH), ("x", EXTRA)):
    ElementTree.register_namespace(prefix, space)


def make_feed(papers, total=None, start=0) -> bytes:
    """A result page built as an XML tree."""
    page = ElementTree.Element(f"{{{ATOM}}}feed")

    def add(parent, name, text=None, space=ATOM, **attributes):
        child = ElementTree.SubElement(parent, f"{{{space}}}{name}", attributes)
        child.text = text
        return child

    add(page, "totalResults", str(len(papers) if total is None else total), SEARCH)
    add(page, "startIndex", str(start), SEARCH)
    for p in papers:
        entry = add(page, "entry")
        for name, field in (("id", "abs_url"), ("title", "title"), ("summary", "abstract"),
                            ("published", "published"), ("updated", "updated")):
            add(entry, name, p[field])
        for author in p["authors"]:
            add(add(entry, "author"), "name", author)
        add(entry, "primary_category", space=EXTRA, term=p["primary_category"])
        for category in p["categories"]:
            add(entry, "category", term=category)
    return ElementTree.tostring(page)


class ScriptedClient:
    """Gives its answers one after the other; those that are exceptions are raised."""

    def __init__(self, *answers):
        self._next = iter(answers).__next__
        self.urls = []

    def get(self, url, content=False):
        self.urls.append(url)
        match self._next():
            case Exception() as problem:
                raise problem
            case body:
                return body
