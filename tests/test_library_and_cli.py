import csv
import json
import re
from unittest.mock import patch

import pytest
from conftest import CONFIG, ScriptedClient, make_feed, make_paper, papers_df
from pyspark.sql import functions as F

from quillspark.cli import main
from quillspark.operators import merge, views
from quillspark.plans.build import build
from quillspark.schema import CATALOG
from quillspark.sinks.files import atomic_write, write_joined
from quillspark.sources import library as files
from quillspark.sources.connector import Connector, FetchError, Response, retry_after_seconds

API = "https://export.arxiv.org/api/query?x=y"


@pytest.fixture
def connector(library):
    return Connector(library.config, library.root)


def test_temporary_failures_are_retried_and_denials_are_not(connector):
    with patch.object(connector, "throttle"), patch("time.sleep"):
        with patch.object(connector, "request", side_effect=[Response(503, b"", {}), Response(200, b"ok", {})]) as r:
            assert connector.get(API) == b"ok" and r.call_count == 2
        for status in (403, 404):
            with patch.object(connector, "request", return_value=Response(status, b"", {})) as r:
                with pytest.raises(FetchError) as failure:
                    connector.get(API)
                assert failure.value.status == status and r.call_count == 1
        with patch.object(connector, "request", side_effect=TimeoutError("slow")) as r:
            with pytest.raises(FetchError):
                connector.get(API)
            assert r.call_count == CONFIG["retries"] + 1
        with patch.object(connector, "request", return_value=Response(429, b"", {"retry-after": "500"})) as r:
            with pytest.raises(FetchError) as failure:
                connector.get(API)
            assert failure.value.status == 429 and r.call_count == 1
    with pytest.raises(FetchError):
        connector.get("https://example.org/")


def test_pauses_double_and_honour_the_server(connector):
    answers = [Response(500, b"", {}), Response(503, b"", {"retry-after": "30"}), Response(502, b"", {}),
               Response(200, b"ok", {})]
    with patch.object(connector, "throttle"), patch("time.sleep") as sleep:
        with patch.object(connector, "request", side_effect=answers):
            connector.get(API)
    assert [c.args[0] for c in sleep.call_args_list] == [5, 30, 20]
    assert retry_after_seconds("soon") == 0 and retry_after_seconds(None) == 0
    assert retry_after_seconds("Wed, 21 Oct 2015 07:28:00 GMT") < 0


def test_the_request_rate_is_kept_across_processes(connector, library):
    with patch("time.time", return_value=100), patch("time.sleep") as sleep:
        connector.throttle(False)
        Connector(library.config, library.root).throttle(False)
        assert sleep.call_args.args[0] == pytest.approx(3.1)
        connector.throttle(True)
        assert sleep.call_args.args[0] == pytest.approx(15.1)
        connector.throttle(False)
        assert sleep.call_args.args[0] == pytest.approx(15.1)


def test_atomic_write_leaves_no_part_behind(tmp_path):
    target = tmp_path / "deep/file.txt"
    atomic_write(target, "one")
    with patch("os.replace", side_effect=OSError("full")), pytest.raises(OSError):
        atomic_write(target, "two")
    assert target.read_text() == "one" and list(target.parent.iterdir()) == [target]


def test_joined_files_are_written_in_order_by_all_tasks(spark, tmp_path):
    lines = spark.range(5000).repartition(7).select(
        F.concat(F.lit("out/"), F.when(F.col("id") % 10 == 0, "small").otherwise("big")).alias("path"), "id",
        F.concat(F.lit("ligne é "), F.col("id").cast("string"), F.lit("\n")).alias("text"))
    write_joined(lines, [F.col("id")], tmp_path)
    for name, wanted in (("small", range(0, 5000, 10)), ("big", [n for n in range(5000) if n % 10])):
        assert (tmp_path / "out" / name).read_text() == "".join(f"ligne é {n}\n" for n in wanted)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["big", "small"]


def library_papers():
    return [make_paper(f"1712.{n:05d}", title=f'Ontology matching "{n}" | <tag>, [x]', abstract=f"Text {n}\nline, two.",
                       doi="10.1/<x>" if n == 3 else "", authors=["A & B", "C"],
                       published=f"20{20 + n}-0{n}-01T00:00:00Z", year_month=f"20{20 + n}-0{n}") for n in range(1, 6)]


def stored(library, papers):
    old = library.spark.createDataFrame([], CATALOG)
    merged = merge.merge(old, papers_df(library.spark, *papers), "stamp")
    gone = F.when(F.col("id") == "1712.00002", False).otherwise(F.col("in_latest_search"))
    library.store.change(lambda _: merged.withColumn("in_latest_search", gone).drop("state"), query="q", last_sync="stamp")


def test_build_writes_linked_views_and_a_readable_table(library):
    stored(library, library_papers())
    assert build(library) == 5
    root = library.root
    assert len(list((root / "cards").glob("*.md"))) == 5
    entry = (root / "ENTRY.md").read_text()
    assert "**4**" in entry and "**5**" in entry and "Text 1" not in entry
    for page in [root / "ENTRY.md", *root.glob("index/**/*.md")]:
        for target in re.findall(r"\]\(([^)]+)\)", page.read_text()):
            assert target.startswith("https://") or (page.parent / target).resolve().exists(), (page, target)
    menu = (root / "index/topics/alignment/README.md").read_text()
    assert menu.startswith("# 本体对齐与实体链接\n\n4 篇") and menu.count("\n- [") == 2
    raw = (root / "index/catalog.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 6
    with open(root / "index/catalog.csv", encoding="utf-8-sig", newline="") as stream:
        rows = list(csv.DictReader(stream))
    assert [r["arxiv_id"] for r in rows] == [f"1712.{n:05d}" for n in (5, 4, 3, 2, 1)]
    assert rows[0]["abstract"] == "Text 5\nline, two." and rows[3]["in_latest_search"] == "False"


def test_cards_read_back(library):
    stored(library, library_papers())
    papers = library.store.papers()
    build(library)
    shared = [c for c in CATALOG.names if c not in (
        "comment", "journal_ref", "primary_category", "first_seen", "last_seen")]
    back = files.cards(library.spark, f"{library.root}/cards").select(*shared)
    assert back.exceptAll(papers.select(*shared)).count() == 0 and back.count() == 5


def test_card_text(spark):
    paper = papers_df(spark, make_paper(doi="")).withColumn("in_latest_search", F.lit(None).cast("boolean"))
    card = views.cards(paper).first().content
    assert card.startswith("# Ontology matching with large models\n\n- arXiv: [1712.00001v1](https://arxiv.org/abs/")
    for line in ("- 作者: Mira Sol\n", "- 分类: cs.DB, stat.CO\n", "- 最近完整搜索中出现: True\n",
                 "- 路由标签（关键词规则）: alignment\n", "- DOI: 未提供\n"):
        assert line in card


def test_command_line(library, spark, capsys):
    def run(*args, client=None, code=0):
        assert main(["--root", str(library.root), *args], spark, client or ScriptedClient()) == code
        return capsys.readouterr()

    assert "all:ontology AND all:language" in run("query").out
    assert json.loads(run("status").out)["papers_stored"] == 0
    assert "没有匹配结果" in run("search", "ontology").out
    papers = library_papers()
    scan = ScriptedClient(*[make_feed(papers[n:n + 2], 5, n) for n in (0, 2, 4)])
    assert '"added": 5' in run("update", client=scan).out
    assert "Indexed 5" in run("reindex").out
    found = run("search", "ontology matching", "--limit", "2", "--abstracts").out
    assert found.count("card: cards/") == 2 and "Text 5" in found
    assert run("search", "ontology", "--year", "2023", "--topic", "alignment").out.count("card:") == 1
    assert "No" not in run("show", "1712.00001", "1712.00002").out
    shown = run("show", "1712.00001", "1712.00002", "--max-chars", "900").out
    assert shown.count("## 原始摘要") == 1 and "输出预算不足" in shown
    assert "not in this catalog" in run("show", "1712.09999", code=1).err
    state = json.loads(run("status").out)
    assert state["papers_in_latest_search"] == 5 and state["index_state"]["catalog_sync"] == state["last_sync_utc"]
    body = b"<article><h1>T</h1><p>" + b"content " * 900 + b"</p></article>"
    run("fetch", "1712.00001", "--format", "html", client=ScriptedClient(body))
    assert json.loads(run("status").out)["current_fulltexts_cached"] == 1
    assert "Chunk: 2" in run("read", "1712.00001", "--chunk", "2").out
    assert "Retry failed IDs" in run("fetch", "1712.00002", "--format", "html",
                                     client=ScriptedClient(FetchError("x", 500)), code=1).err
    assert "either" in run("fetch", code=1).err
    assert "no searchable words" in run("search", "the", code=1).err
    for bad in (["search", "x", "--limit", "51"], ["show", "x", "--max-chars", "10"], ["search", "x", "--topic", "no"]):
        with pytest.raises(SystemExit):
            main(["--root", str(library.root), *bad], spark)
    (library.root / "config.json").unlink()
    assert "config.json" in run("status", code=1).err


def test_interrupt_code(library, spark):
    class Stopped:
        def get(self, *_, **__):
            raise KeyboardInterrupt
    assert main(["--root", str(library.root), "update"], spark, Stopped()) == 130


def test_stale_index_is_not_used(library, spark, capsys):
    stored(library, library_papers())
    build(library)
    state = json.loads(library.state_path.read_text())
    library.state_path.write_text(json.dumps({**state, "catalog_sync": "older"}))
    assert main(["--root", str(library.root), "search", "ontology"], spark) == 0
    assert capsys.readouterr().out.count("card:") == 4
