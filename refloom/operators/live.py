"""Live lookups: a given transport fetches the answers that the store lacks, within a budget, with retries.

A transport is a function from parameters to an answer that raises `TransportError`; it travels to the executors. Requests are distinct by key, so
equal ones are sent once.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.config import SEARCH, Search
from refloom.errors import CheckFailed
from refloom.functions.jsontext import sanitized

ANSWERS = "key string, engine string, query string, created timestamp, body string, attempts int, credits int, waited double, error string"
NO_RESULTS = "hasn't returned any results"
Transport = Callable[[dict], dict]


class TransportError(CheckFailed):
    """A failed request: whether another try can help, and whether it may have been billed (it timed out)."""

    def __init__(self, message: str, retryable: bool, maybe_charged: bool = False):
        super().__init__(message)
        self.retryable, self.maybe_charged = retryable, maybe_charged


def classified(status: Column, error: Column) -> Column:
    """ok, empty, retryable or fatal, of an HTTP status and the body's error text."""
    said = F.coalesce(error, F.lit(""))
    return (
        F.when(status.between(200, 299) & (said == ""), "ok").when(status.between(200, 299) & said.contains(NO_RESULTS), "empty").when(status.between(200, 299), "retryable")
        .when((status == 429) & F.lower(said).contains("run out of searches"), "fatal").when((status == 429) | (status >= 500) | (status < 0), "retryable").otherwise("fatal")
    )


def _created(body: dict) -> datetime | None:
    """When the service first ran the search; older than the request if it came from the service's own cache."""
    try:
        return datetime.strptime(body["search_metadata"]["created_at"], "%Y-%m-%d %H:%M:%S UTC").replace(tzinfo=timezone.utc)
    except (KeyError, TypeError, ValueError):
        return None


def request(params: dict, transport: Transport, cfg: Search = SEARCH, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], datetime] | None = None, jitter: Callable[[float, float], float] = random.uniform) -> dict:
    """One answer: body, attempts, credits, waited, error. A time-out is billed; an answer after one that the service had ready is not."""
    now = clock or (lambda: datetime.now(timezone.utc))
    attempts = credits = 0
    waited, late = 0.0, False
    while True:
        sent = now()
        attempts += 1
        try:
            body = transport(dict(params))
            said = body.get("error") if isinstance(body, dict) else "not JSON"
            if isinstance(said, str) and NO_RESULTS not in said:
                raise TransportError(said, retryable=True)
        except Exception as error:
            # The class may have come to this process twice, with the plan and by import; what it carries tells it.
            if not hasattr(error, "maybe_charged"):
                raise
            credits += error.maybe_charged
            late |= error.maybe_charged
            if not error.retryable or attempts > cfg.max_retries:
                return {"body": None, "attempts": attempts, "credits": credits, "waited": waited, "error": str(error)}
            pause = jitter(0.0, min(cfg.backoff_cap_s, cfg.backoff_base_s * 2 ** (attempts - 1)))
            pause = max(pause, 15.0) if error.maybe_charged else pause
            sleep(pause)
            waited += pause
            continue
        made = _created(body)
        ready = late and made is not None and made < sent - timedelta(seconds=cfg.upstream_cache_margin_s)
        return {"body": body, "attempts": attempts, "credits": credits + (not ready), "waited": waited, "error": None}


def fetched(queries: DataFrame, transport: Transport, cfg: Search = SEARCH, secrets: tuple[str, ...] = (), **doubles) -> DataFrame:
    """queries: key, engine, query, params. Rows of ANSWERS; bodies are cleared of private fields and secrets before they leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, engine, query, params in zip(pdf["key"], pdf["engine"], pdf["query"], pdf["params"], strict=True):
                out = request(dict(params), transport, cfg, **doubles)
                body = None if out["body"] is None else json.dumps(sanitized(out["body"], secrets), ensure_ascii=False, separators=(",", ":"))
                rows.append((key, engine, query, pd.Timestamp.now(tz="UTC").tz_localize(None), body, out["attempts"], int(out["credits"]), out["waited"], out["error"]))
            yield pd.DataFrame(rows, columns=["key", "engine", "query", "created", "body", "attempts", "credits", "waited", "error"])

    return queries.select("key", "engine", "query", "params").mapInPandas(run, ANSWERS)
