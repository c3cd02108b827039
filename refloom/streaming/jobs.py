"""Streams of check jobs: progress, state, expiry, quiet periods and paced requests, on Structured Streaming.

Events: job_id, ts, kind (started, progress, done, failed), idx, verdict. State is kept by job or account and bounded by watermarks or timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from refloom.config import VERDICTS


def progress(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """job_id, done and a count for each verdict so far; update mode. Repeated events of one reference count once."""
    seen = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "idx", "kind"])
    counts = [F.count_if((F.col("kind") == "progress") & (F.col("verdict") == v)).alias(v.lower()) for v in VERDICTS]
    return seen.groupBy("job_id").agg(F.count_if(F.col("kind") == "progress").alias("done"), *counts)


def latest_state(events: DataFrame) -> DataFrame:
    """job_id, state, at: running, done or failed, by the job's latest event."""
    state = F.when(F.col("kind").isin("done", "failed"), F.col("kind")).otherwise("running")
    return events.groupBy("job_id").agg(F.max(F.struct("ts", state.alias("state"))).alias("v")).select("job_id", "v.state", F.col("v.ts").alias("at"))


def expired(jobs: DataFrame, as_of, ttl_s: int = 900) -> DataFrame:
    """Finished jobs that are older than their time."""
    return jobs.where(F.col("state").isin("done", "failed") & (F.col("at") < as_of - F.make_dt_interval(secs=F.lit(float(ttl_s)))))


def event_log(events: DataFrame) -> DataFrame:
    """Events as JSON lines for an append sink; the place in the log is what a reader goes on from."""
    return events.select("job_id", F.to_json(F.struct(*events.columns)).alias("line"))


def quiet_periods(events: DataFrame, gap: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """job_id, start, stop, n: bursts of events with no longer pause than `gap`; a heartbeat is due where one ends. Append mode."""
    bursts = events.withWatermark("ts", delay).groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return bursts.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def paced(requests: DataFrame, per_hour: float, idle: str = "1 hour") -> DataFrame:
    """account, request_id, ts, wait_s of requests (account, request_id, ts): a token bucket for each account. The state is two numbers, and an idle account's is dropped
    once its bucket must be full again."""
    capacity, rate = float(max(1.0, per_hour)), per_hour / 3600.0
    full_ms = int(capacity / rate * 1000)

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        for request_id, ts in zip(rows["request_id"], rows["ts"], strict=True):
            now = ts.timestamp()
            last = now if last is None else last
            tokens = min(capacity, tokens + max(0.0, now - last) * rate) - 1.0
            last = max(last, now)
            out.append((key[0], request_id, ts, max(0.0, -tokens / rate)))
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + full_ms)
        yield pd.DataFrame(out, columns=["account", "request_id", "ts", "wait_s"])

    timed = requests.withWatermark("ts", idle).select("account", "request_id", "ts")
    kind = "account long, request_id long, ts timestamp, wait_s double"
    return timed.groupBy("account").applyInPandasWithState(serve, kind, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def newest_responses(responses: DataFrame) -> DataFrame:
    """A stream of stored responses to the newest of each key; update mode."""
    return responses.groupBy("key").agg(F.max(F.struct("created", "body")).alias("v")).select("key", "v.created", "v.body")


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """An extension of our own: events by type in windows of time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
