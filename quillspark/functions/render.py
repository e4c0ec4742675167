"""Generated Markdown as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quillspark import fixed_values as fixed
from quillspark.functions.ids import file_key, versioned
from quillspark.functions.text import escape

DEFAULT_COMMAND = "python -m quillspark"
LIBRARY_TITLE = "论文知识库：读取入口"


@F.pandas_udf(T.StringType())
def score_text(score: pd.Series) -> pd.Series:
    """Two decimals, rounded on the exact binary value (format_string rounds half up instead)."""
    return score.map("{:.2f}".format)


def python_bool(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise("False")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def card(command: str = DEFAULT_COMMAND) -> Column:
    """The Markdown card of a catalog row with a ``topics`` column."""
    label = fixed.CARD_LABELS
    c = F.col
    base, paper_version = file_key(c("id")), versioned(c("id"), c("version"))
    doi = escape(F.coalesce(c("doi"), F.lit("")))
    return _text(
        "# ", escape(c("title")), "\n\n",
        "- arXiv: [", paper_version, "](", c("abs_url"), ")\n",
        f"- {label['first']}: ", c("year_month"), f"；{label['submitted']}: ", c("published"), "\n",
        f"- {label['revised']}: ", c("updated"), "\n",
        f"- {label['authors']}: ", escape(F.array_join("authors", "; ")), "\n",
        f"- {label['categories']}: ", F.array_join("categories", ", "), "\n",
        f"- {label['current']}: ", python_bool(F.coalesce(c("in_latest_search"), F.lit(True))), "\n",
        f"- {label['topics']}: ", F.array_join("topics", ", "), "\n",
        "- PDF: ", c("pdf_url"), "\n",
        "- DOI: ", F.when(doi == "", F.lit(label["no_doi"])).otherwise(doi), "\n\n",
        f"## {label['abstract']}\n\n", c("abstract"), "\n\n",
        f"## {label['read_on']}\n\n",
        fixed.CARD_FETCH_HINT[0] + command + " fetch ", c("id"), fixed.CARD_FETCH_HINT[1] + "\n",
        fixed.CARD_READ_HINT[0], base, "/", versioned(base, c("version")),
        fixed.CARD_READ_HINT[1] + "\n", fixed.CARD_NOTICE + "\n")


def shard_row() -> Column:
    c = F.col
    return _text("| ", c("year_month"), " | ", versioned(c("id"), c("version")), " | [",
                 escape(c("title")), "](../../../cards/", file_key(c("id")), ".md) |")


def search_block(abstracts: bool) -> Column:
    c = F.col
    block = _text("\n- ", versioned(c("id"), c("version")), " | ", c("year_month"), " | ", c("title"),
                  "\n  card: cards/", file_key(c("id")), ".md | score: ", score_text(c("score")), "\n")
    return _text(block, fixed.SEARCH_ABSTRACT_LABEL, c("abstract"), "\n") if abstracts else block


def chunk_body(source: Column, number: Column, label: Column, text: Column) -> Column:
    return _text("Source: ", source, "\nChunk: ", number.cast("string"), "\nSection/page: ", label,
                 "\n\n", text, "\n")


def chunk_path(number: Column) -> Column:
    return _text("chunks/", F.format_string("%04d", number), ".md")


def contents_page(title: Column, paper_version: Column, source: Column, stamp: str,
                  warnings: Column, rows: Column) -> Column:
    head = _text("# ", title, "\n\narXiv: ", paper_version, "\nSource: ", source,
                 f"\nExtracted: {stamp}\n\n{fixed.CONTENTS_NOTICE}\n\n## Extraction notes\n\n")
    notes = F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n")
    return _text(head, notes, "\n\n## Chunks\n\n", fixed.CONTENTS_TABLE_HEAD, "\n",
                 F.array_join(rows, "\n"), F.when(F.size(rows) > 0, "\n").otherwise(""))


def contents_row(number: Column, label: Column, chars: Column) -> Column:
    shown = F.replace(F.substring(label, 1, fixed.CONTENTS_LABEL_CHARS), F.lit("|"), F.lit("&#124;"))
    return _text("| [", F.format_string("%04d", number), "](", chunk_path(number), ") | ", shown, " | ",
                 chars.cast("string"), " |")


