"""Tunables, passed as parameters and never read from globals by the operators.

The numbers and word lists are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

VERDICTS = ("VERIFIED", "METADATA_MISMATCH", "NOT_FOUND", "UNPARSEABLE", "SKIPPED_BUDGET")
FIELDS = ("title", "authors", "year", "venue", "doi")
SCHOLAR, WEB = "google_scholar", "google"


@dataclass(frozen=True)
class Ingest:
    max_input_bytes: int = 10 * 1024 * 1024
    max_pdf_pages: int = 400
    min_text_chars_per_page: int = 20
    max_references: int = 1000


@dataclass(frozen=True)
class Parse:
    as_of_year: int = 2026
    min_year: int = 1800
    year_future_slack: int = 1
    min_title_chars: int = 10


@dataclass(frozen=True)
class Search:
    max_searches: int = 50
    max_retries: int = 3
    backoff_base_s: float = 1.0
    backoff_cap_s: float = 20.0
    upstream_cache_margin_s: int = 10
    results_per_query: int = 10
    cache_ttl_days: int = 30
    searches_per_reference: float = 1.5
    rate_limit_share: float = 0.8
    language: str = "en"
    country: str = "in"
    max_query_chars: int = 256
    web_types: tuple[str, ...] = ("book", "inbook", "incollection", "booklet", "phdthesis", "mastersthesis", "thesis", "techreport", "report", "manual")


@dataclass(frozen=True)
class Match:
    title_match: float = 0.90
    word_match: float = 0.80
    title_reject: float = 0.70
    overlap_min_words: int = 3
    subtitle_score: float = 0.90
    surname_match: float = 0.85
    partial_year_score: float = 0.8
    edition_types: tuple[str, ...] = ("book",)
    year_tolerance: int = 1
    author_overlap: float = 0.5
    venue_match: float = 0.70
    weight_title: float = 0.55
    weight_authors: float = 0.20
    weight_year: float = 0.15
    weight_venue: float = 0.10
    doi_confidence: float = 0.98
    web_cap: float = 0.70


@dataclass(frozen=True)
class Verdict:
    not_found_confidence: float = 0.9
    not_found_floor: float = 0.5
    mismatch_weight: float = 0.5


INGEST, PARSE, SEARCH, MATCH, VERDICT = Ingest(), Parse(), Search(), Match(), Verdict()
