"""Library configuration and the request texts derived from it."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import urlencode

from quillspark import fixed_values as fixed


@dataclass(frozen=True)
class Config:
    terms: list[str]
    subjects: list[str]
    page_size: int
    api_delay_seconds: float
    content_delay_seconds: float
    timeout_seconds: float
    retries: int
    user_agent: str
    title_page_size: int
    chunk_chars: int

    def __post_init__(self):
        if not self.subjects or set(self.subjects) - set(fixed.SUBJECT_FORM_NAMES):
            raise ValueError(f"subjects must be some of {'/'.join(fixed.SUBJECT_FORM_NAMES)}")
        if not self.terms or not all(re.fullmatch(fixed.TERM_PATTERN, t) for t in self.terms):
            raise ValueError("terms may hold words, spaces, hyphens and quoted phrases, at least one")
        for name, low, high in fixed.CONFIG_RANGES:
            value = getattr(self, name)
            if not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")
        if (self.api_delay_seconds < fixed.MIN_API_DELAY_SECONDS
                or self.content_delay_seconds < fixed.MIN_CONTENT_DELAY_SECONDS):
            raise ValueError("The delays are below the minimum of 3 (API) and 15 (content) seconds")
        if not 0 <= self.retries <= 5 or not 1 <= self.timeout_seconds <= 300:
            raise ValueError("retries must be 0 to 5 and timeout_seconds 1 to 300")


def load_config(root: Path) -> Config:
    path = Path(root) / "config.json"
    if not path.exists():
        raise ValueError(f"No config.json in {root}")
    values = json.loads(path.read_text(encoding="utf-8"))
    return Config(**{f.name: values[f.name] for f in fields(Config)})


def api_query(config: Config) -> str:
    """The API query: quoted terms stay phrases, the words of other terms are ANDed."""
    words = [word for term in config.terms
             for word in ([term] if re.fullmatch('".*"', term, re.S) else term.split())]
    wanted = " AND ".join(f"all:{word}" for word in words)
    scope = " OR ".join(f"cat:{subject}.*" for subject in config.subjects)
    return f"{wanted} AND ({scope})"


def page_url(config: Config, offset: int) -> str:
    return f"{fixed.API_ENDPOINT}?" + urlencode([
        ("search_query", api_query(config)), ("start", offset), ("max_results", config.page_size),
        ("sortBy", "submittedDate"), ("sortOrder", "descending")])


def search_url(config: Config) -> str:
    """The address of the equivalent advanced search form."""
    pairs = [("advanced", "1")]
    for number, term in enumerate(config.terms):
        pairs += [(f"terms-{number}-operator", "AND"), (f"terms-{number}-term", term),
                  (f"terms-{number}-field", "all")]
    pairs += [(f"classification-{fixed.SUBJECT_FORM_NAMES[s]}", "y")
              for s in dict.fromkeys(config.subjects)]
    return f"{fixed.SEARCH_ENDPOINT}?" + urlencode(pairs + fixed.SEARCH_FORM_TAIL)


def digest(value) -> str:
    """SHA-256 of a value's JSON text with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def scan_identity(config: Config) -> str:
    return digest({"query": api_query(config), "page_size": config.page_size})
