"""Cutting text into chunks under a hard character ceiling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from quillspark import schema
from quillspark.functions.html import blocks_or_error
from quillspark.functions.text import WHITESPACE_CLASS, let

JOINER = "\n\n"


def chunk_text(text: Column, max_chars: int) -> Column:
    """Chunks of a text that is a single block, as one JVM expression.

    The three alternatives in order: what is left fits; the longest cut before a space or newline in
    the second half of the room; a hard cut. White space after a cut is dropped.
    """
    pattern = (rf"(?s)(.{{1,{max_chars}}}\z"
               rf"|.{{{max_chars // 2 + 1},{max_chars - 1}}}(?=[ \n])"
               rf"|.{{{max_chars}}}){WHITESPACE_CLASS}*")
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _head(text: str, room: int) -> str:
    """The part of ``text`` that goes into ``room`` characters, cut at white space if that is late."""
    if len(text) <= room:
        return text
    cut = max(text.rfind("\n", 0, room), text.rfind(" ", 0, room))
    return text[:cut] if cut > room // 2 else text[:room]


def section_chunks(blocks: Iterable[tuple[str, str]], max_chars: int) -> Iterator[tuple[str, str]]:
    """(section, text) chunks of labelled blocks; a chunk never spans two sections."""
    section, parts, size = None, [], 0
    for label, rest in blocks:
        if parts and label != section:
            yield section, JOINER.join(parts)
            parts, size = [], 0
        while rest:
            gap = len(JOINER) if parts else 0
            room = max_chars - size - gap
            if room > 0:
                piece = _head(rest, room)
                section = label
                parts.append(piece)
                size += gap + len(piece)
                rest = rest[len(piece):].lstrip()
            if parts and (rest or room <= 0):
                yield section, JOINER.join(parts)
                parts, size = [], 0
    if parts:
        yield section, JOINER.join(parts)


def fold_sections(blocks: Column, max_chars: int) -> Column:
    """array<struct<text, sections>> of labelled blocks (array<struct<label, text>>), like section_chunks, as one fold.

    The state is what was closed and the open chunk with its section. A block fills the open chunk of its section up to
    the ceiling; what is left of it is cut like a text of a single block, and its last piece stays open. Blocks without
    a text are passed over.
    """
    state_type = "struct<closed: array<struct<text: string, sections: array<string>>>, label: string, open: string>"
    start = F.from_json(F.lit('{"closed": [], "label": null, "open": ""}'), state_type)

    def closed(state: Column) -> Column:
        own = F.array(F.struct(state["open"].alias("text"), F.array(state["label"]).alias("sections")))
        return F.when(state["open"] == "", state["closed"]).otherwise(F.concat(state["closed"], own))

    def room_in(state: Column, block: Column) -> Column:
        used = F.when(state["open"] == "", 0).otherwise(F.length(state["open"]) + len(JOINER))
        same = (state["open"] == "") | state["label"].eqNullSafe(block["label"])
        return F.when(same, max_chars - used).otherwise(0)

    def head(text: Column, room: Column) -> Column:
        sub = F.substring(text, F.lit(1), room)
        back = F.reverse(sub)
        spaces = F.array_min(F.filter(F.array(F.instr(back, " "), F.instr(back, "\n")), lambda i: i > 0))
        cut = room - F.coalesce(spaces, room)
        return F.when(F.length(text) <= room, text).when(
            cut > F.floor(room / 2), F.substring(text, F.lit(1), cut)).otherwise(sub)

    def added(state: Column, block: Column) -> Column:
        def filled(room: Column) -> Column:
            def rest_after(piece: Column) -> Column:
                tail = F.substring(block["text"], F.length(piece) + 1, F.length(block["text"]))
                return F.when(piece == "", block["text"]).otherwise(F.regexp_replace(tail, f"^{WHITESPACE_CLASS}+", ""))

            return let(F.when(room > 0, head(block["text"], room)).otherwise(F.lit("")), lambda piece: let(
                rest_after(piece), lambda rest: after(piece, rest)))

        def after(piece: Column, rest: Column) -> Column:
            grown = F.when(piece == "", state["open"]).when(state["open"] == "", piece).otherwise(
                F.concat(state["open"], F.lit(JOINER), piece))
            label = F.when(piece == "", state["label"]).otherwise(block["label"])
            now = F.struct(state["closed"].alias("closed"), label.alias("label"), grown.alias("open"))
            return F.when(rest == "", now).otherwise(let(chunk_text(rest, max_chars), lambda pieces: F.struct(
                F.concat(closed(now), F.transform(
                    F.slice(pieces, F.lit(1), F.size(pieces) - 1),
                    lambda p: F.struct(p.alias("text"), F.array(block["label"]).alias("sections")))).alias("closed"),
                block["label"].alias("label"), F.element_at(pieces, -1).alias("open"))))

        return let(room_in(state, block), filled)

    usable = F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != "")
    return F.aggregate(usable, start, lambda s, b: added(s, b).cast(state_type), closed)


def _as_rows(chunks: Iterable[tuple[str, str]]) -> list[dict]:
    return [{"text": text, "sections": [section]} for section, text in chunks]


def chunk_blocks(blocks: Column, max_chars: int) -> Column:
    """array<struct<text, sections>> of an array of labelled blocks."""
    @F.pandas_udf(schema.CHUNKS)
    def cut(documents: pd.Series) -> pd.Series:
        return documents.map(lambda doc: None if doc is None else _as_rows(
            section_chunks(((b["label"], b["text"]) for b in doc), max_chars)))
    return cut(blocks)


def html_chunks(markup: Column, max_chars: int) -> Column:
    """struct<chunks, error> of HTML documents: extraction and cutting in one pass through Python."""
    @F.pandas_udf(schema.EXTRACTED_CHUNKS)
    def extract(documents: pd.Series) -> pd.DataFrame:
        found = [blocks_or_error(d) for d in documents]
        return pd.DataFrame({
            "chunks": [None if b is None else _as_rows(section_chunks(b, max_chars)) for b, _ in found],
            "error": [e for _, e in found]})
    return extract(markup)
