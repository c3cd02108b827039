"""Private fields and secrets out of JSON values of any shape."""

from __future__ import annotations

from typing import Any

from refloom.errors import redact

# Fields of an account, and where a service keeps an account's searches.
DROPPED = frozenset({"api_key", "json_endpoint", "raw_html_file", "prettify_html_file", "pixel_position_endpoint"})
ARCHIVE = "/searches/"


def sanitized(value: Any, secrets: tuple[str, ...] = ()) -> Any:
    """A copy without an account's fields, endpoints and archive links, its texts redacted."""
    if isinstance(value, dict):
        private = lambda k, v: k in DROPPED or k.endswith("_endpoint") or isinstance(v, str) and ARCHIVE in v
        return {str(k): sanitized(v, secrets) for k, v in value.items() if not private(str(k), v)}
    if isinstance(value, list):
        return [sanitized(v, secrets) for v in value]
    return redact(value, secrets) if isinstance(value, str) else value
