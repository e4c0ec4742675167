"""Text expressions. All are plain Column expressions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from quillspark import fixed_values as fixed

# Everything Python's str.split() and str.strip() treat as white space.
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean(text: Column) -> Column:
    """Collapse white space to single spaces and strip the ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE_CLASS + "+", " "))


def expanded_lower(text: Column, aliases=fixed.QUERY_ALIASES) -> Column:
    """Lower-case text with alias phrases replaced, in order, by their space-padded expansions."""
    expanded = reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(f" {pair[1]} ")), aliases, F.lower(text))
    if any(phrase.isascii() for phrase, _ in aliases):
        return expanded
    # No alias can occur in pure ASCII text, which this length comparison recognises cheaply.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(expanded)


def singular(word: Column) -> Column:
    """Irregular plurals by table; otherwise drop one trailing 's' from words longer than four."""
    regular = F.when(
        (F.length(word) > 4) & word.endswith("s") & ~word.endswith("ss"),
        F.substring(word, F.lit(1), F.length(word) - 1),
    ).otherwise(word)
    for plural, base in fixed.IRREGULAR_PLURALS:
        regular = F.when(word == plural, F.lit(base)).otherwise(regular)
    return regular


def content_words(text: Column) -> Column:
    """Lower-case ASCII words of the alias-expanded text without stop words (before stemming)."""
    words = F.regexp_extract_all(expanded_lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(fixed.STOP_WORDS))


def tokens(text: Column) -> Column:
    """The search tokens of a text, in order, repeats kept."""
    return F.transform(content_words(text), singular)


def escape(text: Column) -> Column:
    """Escape text for Markdown tables and links."""
    # Replacements, in order.
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                     ("|", "&#124;"), ("[", "&#91;"), ("]", "&#93;"), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def padded(number: Column, width: int) -> Column:
    """Zero-padded decimal text that never truncates."""
    return F.format_string(f"%0{width}d", number)


def truncated(text: Column, max_chars: int, marker: str = fixed.READ_OVERFLOW) -> Column:
    """Text of at most ``max_chars`` characters; a cut text ends with ``marker``."""
    kept = F.substring(text, 1, max(0, max_chars - len(marker)))
    return F.when(F.length(text) > max_chars, F.concat(kept, F.lit(marker))).otherwise(text)


def year_month(published: Column) -> Column:
    return F.substring(published, 1, 7)


def is_iso_time(text: Column) -> Column:
    shape = (r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?\z")
    return text.rlike(shape) & F.try_to_timestamp(text).isNotNull()


def subject(category: Column) -> Column:
    return F.split(category, r"\.")[0]


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
