"""PDF bodies to one labelled block per page. The PDF reader is an optional dependency."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import functions as F

from quillspark import fixed_values as fixed, schema


def page_texts(body: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as problem:
        raise RuntimeError("PDF extraction needs the optional pypdf package") from problem
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(body)).pages]


def pdf_blocks(body: bytes, read_pages=page_texts) -> tuple[list[tuple[str, str]], list[str]]:
    """(blocks, warnings); raises ValueError when the body has no usable text."""
    if not body.startswith(b"%PDF-"):
        raise ValueError("Downloaded body is not a PDF")
    try:
        texts = [text.strip() for text in read_pages(body)]
    except RuntimeError:
        raise
    except Exception as problem:  # the reader raises many types on damaged files
        raise ValueError(f"PDF extraction failed: {problem}") from problem
    scanty = [n for n, text in enumerate(texts, 1) if len(text) < fixed.MIN_PDF_PAGE_CHARS]
    if len(scanty) == len(texts):
        raise ValueError("PDF has no usable text layer; OCR is required")
    blocks = []
    for number, text in enumerate(texts, 1):
        shown = f"{fixed.PDF_EMPTY_PAGE}\n{text}" if number in scanty else text
        label = f"PDF page {number}"
        blocks.append((label, f"## {label}\n\n{shown}"))
    warnings = [fixed.PDF_NOTE]
    if scanty:
        warnings.append(fixed.PDF_EMPTY_PAGES_NOTE + ", ".join(map(str, scanty)))
    return blocks, warnings


@F.pandas_udf(schema.EXTRACTED_PAGES)
def pdf_page_blocks(body: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in body:
        try:
            blocks, warnings = pdf_blocks(bytes(raw))
            rows.append(([{"label": k, "text": t} for k, t in blocks], warnings, None))
        except (RuntimeError, ValueError) as problem:
            rows.append((None, None, str(problem)))
    return pd.DataFrame(rows, columns=["blocks", "warnings", "error"])
