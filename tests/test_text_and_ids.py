import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import ids, render, text
from quillspark.operators.routing import boundary_pattern, topic_ids


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, items, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.x for r in rows.orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def test_clean_matches_python_split(spark):
    samples = [" a 　b\n\tc ", None, "", "\x1c\x85x y", "plain"]
    assert values(spark, samples, text.clean) == [" ".join((s or "").split()) for s in samples]


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=200, max_size=200))
def test_clean_property(spark, samples):
    samples = [s.replace("\x00", "").encode("utf-8", "ignore").decode() for s in samples]
    assert values(spark, samples, text.clean) == [" ".join(s.split()) for s in samples]


def test_parse_ids(spark):
    good = {
        "https://arxiv.org/pdf/cs/9901001v2.pdf": ("cs/9901001", 2),
        "http://export.arxiv.org/abs/1712.03411": ("1712.03411", None),
        " 1712.12345v12\n": ("1712.12345", 12),
        "CMP-LG/9901001": ("CMP-LG/9901001", None),
        "1712.03411V2": ("1712.03411", 2),
        "math.GT/0309136V" + "9" * 18: ("math.GT/0309136", 10 ** 18 - 1),
    }
    bad = ["../../a", "1712.03411/../../x", "1712.03411v0", "https://evil.test/1712.03411", "", "cs_9901001",
           "1712.03411v" + "9" * 19]
    parsed = values(spark, list(good) + bad, ids.parse_id)
    assert [(p.base, p.version) for p in parsed[:len(good)]] == list(good.values())
    assert parsed[len(good):] == [None] * len(bad)
    for value, expected in good.items():
        assert ids.parse_id_text(value) == expected
    for value in bad:
        with pytest.raises(ValueError):
            ids.parse_id_text(value)
    assert values(spark, ["cs/9901001v2", "1712.03411"], ids.safe_id) == ["cs_9901001v2", "1712.03411"]


def test_tokens_aliases_stops_and_plurals(spark):
    samples = ["本体对齐", "大语言模型", "大模型", "Using the ontologies, class glass buses uses bases naïve"]
    assert values(spark, samples, text.tokens) == [
        ["ontology", "alignment", "matching"], ["language", "model"], ["language", "model", "llm"],
        ["ontology", "class", "glass", "buse", "uses", "base", "na", "ve"]]


def test_escape_and_padding(spark):
    assert one(spark, text.escape(F.lit('a|b [c] <d> & "e"\nf'))) == (
        'a&#124;b &#91;c&#93; &lt;d&gt; &amp; "e" f')
    assert [one(spark, text.padded(F.lit(n), 3)) for n in (7, 1234)] == ["007", "1234"]


def test_topics_use_unicode_word_boundaries(spark):
    rows = spark.createDataFrame([
        ("Knowledge graphs", "plain"), ("x", "storage of rags"), ("RAG", "legalese"),
        ("neuro-symbolic", "ontology learning, survey"), ("éowl", "owl_x xowl"), ("a", "an owl.")],
        "title string, abstract string")
    found = [r.t for r in rows.select(topic_ids(F.col("title"), F.col("abstract")).alias("t")).collect()]
    assert found == [["knowledge_graph"], ["other"], ["retrieval"],
                     ["construction", "reasoning", "evaluation"], ["other"], ["reasoning"]]


@pytest.mark.parametrize("term", ["c++", "-x", "a.b"])
def test_boundaries_of_terms_with_symbols_follow_word_transitions(spark, term):
    import re
    samples = [f"{a}{term}{b}" for a in ("", " ", "y", ".") for b in ("", " ", "z", ".")]
    expected = [bool(re.search(r"\b" + re.escape(term) + r"\b", s)) for s in samples]
    assert values(spark, samples, lambda c: c.rlike(boundary_pattern(term))) == expected


def test_truncation_keeps_the_budget(spark):
    cut = one(spark, text.truncated(F.lit("本" * 600), 500))
    assert len(cut) == 500 and cut.startswith("本")
    assert one(spark, text.truncated(F.lit("short"), 500)) == "short"


def test_score_text_rounds_like_python(spark):
    numbers = [2.675, 0.125, 1.005, 12.0]
    rows = spark.createDataFrame([(n,) for n in numbers], "n double").coalesce(1)
    shown = [r.s for r in rows.select(render.score_text("n").alias("s")).collect()]
    assert shown == [f"{n:.2f}" for n in numbers]
