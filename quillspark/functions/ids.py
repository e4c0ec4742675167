"""Paper identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillspark import fixed_values as fixed
from quillspark.functions.text import WHITESPACE_CLASS


MAX_VERSION_DIGITS = 18


def _bare(value: Column) -> Column:
    stripped = F.regexp_replace(value, rf"\A{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+\z", "")
    return F.regexp_replace(F.regexp_replace(stripped, fixed.ID_URL_PREFIX, ""), r"\.pdf\z", "")


def parse_id(value: Column) -> Column:
    """struct<base, version> of an identifier or paper URL; NULL when it is not valid.

    A version of more than MAX_VERSION_DIGITS digits is not valid, so it never passes for a missing one.
    """
    bare = _bare(value)
    whole = rf"\A{fixed.ID_PATTERN}\z"
    version = F.regexp_extract(bare, whole, 2)
    return F.when(
        bare.rlike(whole) & (F.length(version) <= MAX_VERSION_DIGITS),
        F.struct(F.regexp_extract(bare, whole, 1).alias("base"),
                 F.nullif(version, F.lit("")).cast("bigint").alias("version")),
    )


def safe_id(value: Column) -> Column:
    """File-system-safe form of an identifier; keeps the version; NULL when it is not valid."""
    parsed = parse_id(value)
    return F.when(parsed.isNotNull(), F.concat(
        F.replace(parsed["base"], F.lit("/"), F.lit("_")),
        F.coalesce(F.concat(F.lit("v"), parsed["version"].cast("string")), F.lit("")),
    ))


def file_key(base: Column) -> Column:
    """``safe_id`` for a value already known to be a bare catalog identifier."""
    return F.replace(base, F.lit("/"), F.lit("_"))


def versioned(base: Column, version: Column) -> Column:
    return F.concat(base, F.lit("v"), version.cast("string"))


def parse_id_text(value: str) -> tuple[str, int | None]:
    """The same rule for one identifier typed by a user."""
    bare = re.sub(fixed.ID_URL_PREFIX, "", value.strip()).removesuffix(".pdf")
    match = re.fullmatch(fixed.ID_PATTERN, bare, re.ASCII)
    if match is None or len(match[2] or "") > MAX_VERSION_DIGITS:
        raise ValueError(f"Not a valid paper identifier: {bare}")
    return match[1], int(match[2]) if match[2] else None
